"""Structure of source files as tables: tokens, blocks, statements, declarations and calls.

A file becomes a table of tokens, each with its line and with how many braces and brackets are open before it (running
sums over the file's places).  Comments are no tokens, and a string is one, so neither braces nor words in them count.

* A brace's partner is the next brace of the same level.
* A statement ends at ``;``, ``{`` or before ``}`` outside brackets (in some languages also at the end of a line); its tokens, joined by
  single blanks, are what a language's rules are about.
* A declaration is a statement that a rule knows, in a place where it may stand: at the top, in a namespace or directly in a
  type's block.  What it belongs to is the last block of the level around it that was opened before.
* A call is a chain of names before a bracket; its caller is the innermost declared function whose interval of places contains it (functions inside functions are not declared).

Windows and joins are within a file, so the work is spread by files; nothing is collected but the tokens of one statement.
A null or empty content has no rows; braces that nothing closes end with the file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text, about, whose tokens one task holds.
TEXT = 1 << 22
_LINE = r"//[^\n]*|/\*[\s\S]*?\*/"
_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_CHARS = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_LONG = r'"""[\s\S]*?"""'
_SIGNS = r"::|->|=>|\?\.|\?->|\.\.\.|&&|\|\||\n|[^\s\w]"
_WORDS = r"[A-Za-z_$][\w$]*|\d[\w.]*"


def _tokens(*strings: str, words: str = _WORDS, comments: str = _LINE) -> str:
    return "|".join([comments, *strings, words, _SIGNS])


_ID = r"[A-Za-z_]\w*"
_INSIDE = r"((?:[^()]|\([^()]*\))*?)"
#: A type before a name: names, dots, angles, square brackets, stars.
_KIND = r"((?:[\w.:]+|<[^(){}]*>|\[ ?\]|[*&?]+)(?: (?:[\w.:]+|<[^(){}]*>|\[ ?\]|[*&?]+))*?)"

_TYPED = "(?:" + _KIND[1:]


def _words(names: str) -> str:
    return f"((?:(?:{names}) )*)"


@dataclass
class Rules:
    """What a language's statements are: patterns on tokens joined by single blanks, with the group of each part (0: none)."""

    tokens: str
    types: str  # groups: modifiers, word, name
    functions: str
    parts: tuple[int, int, int, int, int]  # of functions: modifiers, owner, name, parameters, returns
    fields: str = ""  # groups: modifiers, name
    around: str = ""  # blocks that are nothing themselves; group: what they give their members to, if anything
    named: str = r"(\w+) ?(?:=.*)?$"  # a parameter's name
    exported: Callable[[Column, Column], Column] = lambda mods, name: mods.contains("public")
    lines: bool = False  # a line's end ends a statement
    top: str = ""  # what a function must hold outside types, where its head could be a call


_ANNOTATED = r"^(?:@ \w+(?: \. \w+)*(?: \( (?:[^()]|\([^()]*\))*\))? )*"
_JAVA = _words("public|private|protected|static|final|abstract|synchronized|native|default|strictfp|sealed")
_CS = _words("public|private|protected|internal|static|virtual|override|abstract|sealed|async|partial|readonly|unsafe|extern|new|const|required")
_KT = _words("public|private|protected|internal|open|abstract|final|override|suspend|inline|operator|data|sealed|inner|tailrec|infix|enum|annotation|value|companion|const|lateinit")
_SWIFT = _words("public|private|fileprivate|internal|open|static|class|final|override|mutating|nonmutating|convenience|required|indirect|lazy|weak")
_SC_TYPE = _words(r"private(?: \[ [^]]* \])?|protected|final|sealed|abstract|implicit|lazy|case|open|override|inline|transparent")
_SC_DEF = _words(r"private(?: \[ [^]]* \])?|protected|final|override|implicit|inline|abstract")
_SC_VAL = _words(r"private(?: \[ [^]]* \])?|protected|final|override|implicit|lazy")
_NOT = r"(?!return |new |else |throw |await |case |using |package |import |goto |yield )"
_RUST = r"^(?:# !? ?\[ (?:[^\[\]]|\[[^\[\]]*\])*\] )*((?:pub (?:\( [^)]*\) )?)?)(?:(?:const|async|unsafe|default|extern) )*"
_CPP = r"^(?:(?:public|private|protected) : )*(?:template < .*? > )?"

RULES: dict[str, Rules] = {
    "java": Rules(
        _tokens(_LONG, _STRING, _CHARS),
        rf"{_ANNOTATED}{_JAVA}(?:@ )?(class|interface|enum|record) ({_ID})\b",
        rf"{_ANNOTATED}{_JAVA}(?:< .*? > )?(?:{_NOT}{_KIND} )?({_ID}) \( ?{_INSIDE} ?\)(?: throws [\w ., ]+?)? [{{;]$",
        (1, 0, 3, 4, 2),
        rf"{_ANNOTATED}{_JAVA}{_NOT}{_TYPED} ({_ID})(?: =.*)? ;$",
    ),
    "csharp": Rules(
        _tokens(_LONG, r'@"(?:[^"]|"")*+"', _STRING, _CHARS),
        rf"^(?:\[ [^\]]*\] )*{_CS}(class|interface|struct|enum|record(?: class| struct)?) ({_ID})\b",
        rf"^(?:\[ [^\]]*\] )*{_CS}(?:{_NOT}{_KIND} )?({_ID})(?: <[^(){{}}]*>)? \( ?{_INSIDE} ?\)(?: : (?:base|this) \(.*\))?(?: where .*?)?(?: => .*)? [{{;]$",
        (1, 0, 3, 4, 2),
        rf"^(?:\[ [^\]]*\] )*{_CS}{_NOT}{_TYPED} ({_ID})(?: =.*)?(?: ;| \{{)$",
        around=r"^namespace ()[\w. ]+ [{]$",
    ),
    "go": Rules(
        _tokens(r"`[^`]*`", _STRING, _CHARS),
        rf"^()(type) ({_ID})(?: \[ .*? \])? (?:struct|interface) \{{$",
        rf"^()func (?:\( (?:\w+ )?(?:\* )?({_ID})(?: \[.*?\])? \) )?({_ID})(?: \[ .*? \])? \( ?{_INSIDE} ?\) ?(.*?) ?\{{$",
        (1, 2, 3, 4, 5),
        rf"^()({_ID}) (?!\()[\w*\[\]].*$",
        named=r"^(\w+)",
        exported=lambda mods, name: name.rlike("^[A-Z]"),
        lines=True,
    ),
    "rust": Rules(
        _tokens(_STRING, r"'(?:\\[^'\n]*|[^'\\\n])'"),
        rf"{_RUST}(struct|enum|trait|union) ({_ID})\b",
        rf"{_RUST}fn ({_ID})(?: < .*? >)? \( ?{_INSIDE} ?\)(?: -> (.*?))?(?: where .*?)? [{{;]$",
        (1, 0, 2, 3, 4),
        around=rf"^(?:unsafe )?(?:impl(?: < .*? >)? (?:.*? for )?(?:& )?(?:\w+ :: )*({_ID})(?: <.*>)?(?: where .*)?|(?:pub )?mod \w+) \{{$",
        named=r"^(?:& ?)?(?:' \w+ )?(?:mut )?(\w+)(?: :.*)?$",
        exported=lambda mods, name: mods.startswith("pub"),
    ),
    "php": Rules(
        _tokens(_STRING, _CHARS, words=r"\$?[A-Za-z_\\][\w\\]*|\d[\w.]*", comments=_LINE + r"|#(?!\[)[^\n]*|<\?(?:php|=)?|\?>"),
        rf"^(?:# \[ [^\]]*\] )*((?:(?:final|abstract|readonly) )*)(class|interface|trait|enum) ({_ID})\b",
        rf"^(?:# \[ [^\]]*\] )*((?:(?:public|private|protected|static|final|abstract) )*)function (?:& )?({_ID}) \( ?{_INSIDE} ?\)(?: : (.*?))? [{{;]$",
        (1, 0, 2, 3, 4),
        r"^((?:(?:public|private|protected|static|readonly|var) )+)(?:\?? ?[\w\\|]+ )?(\$\w+)(?: =.*)? ;$",
        around=r"^namespace ()[\w\\]* ?[{]$",
        named=r"\$(\w+)",
        exported=lambda mods, name: ~mods.rlike("private|protected"),
    ),
    "cpp": Rules(
        _tokens(_STRING, r"'(?:\\[^'\n]*|[^'\\\n])'", comments=_LINE + r"|#[^\n]*"),
        rf"{_CPP}()(class|struct) ({_ID})(?: final)?(?: : [^;]*)? \{{$",
        rf"{_CPP}{_words('static|inline|virtual|explicit|constexpr|extern|friend')}(?:{_NOT}{_KIND} )?(?:(?:{_ID} :: )*({_ID}) :: )?(~ ?{_ID}|{_ID}) \( ?{_INSIDE} ?\)(?: (?:const|noexcept|override|final))*(?: : .*| -> .*| = (?:0|default|delete))? [{{;]$",
        (1, 3, 4, 5, 2),
        rf"{_CPP}{_words('static|mutable|constexpr|const')}{_NOT}{_TYPED} ({_ID})(?: =.*| \[.*\])? ;$",
        around=r"^(?:inline )?(?:namespace(?: ()[\w: ]+)?|extern \".*\") \{$",
        exported=lambda mods, name: ~mods.contains("static"),
    ),
    "kotlin": Rules(
        _tokens(_LONG, _STRING, _CHARS),
        rf"{_ANNOTATED}{_KT}(class|interface|object) ({_ID})\b",
        rf"{_ANNOTATED}{_KT}fun (?:< .*? > )?(?:[\w<>, ]+ \. )?({_ID}) \( ?{_INSIDE} ?\)(?: : ([^={{]*?))?(?: where .*?)?(?: =.*| \{{)?$",
        (1, 0, 2, 3, 4),
        rf"{_ANNOTATED}{_KT}(?:val|var) ({_ID})\b.*$",
        named=r"^(?:vararg |noinline |crossinline )?(\w+) ?:",
        exported=lambda mods, name: ~mods.contains("private"),
        lines=True,
    ),
    "swift": Rules(
        _tokens(_LONG, _STRING),
        rf"{_ANNOTATED}{_SWIFT}((?<!\w)(?:class|struct|enum|actor|protocol|extension)) ({_ID})\b(?!.*\bfunc\b)",
        rf"{_ANNOTATED}{_SWIFT}(?:func ({_ID}|[^\w\s]+)|(?:init)(?= ?[?!]? ?\())(?: < .*? >)? ?[?!]? ?\( ?{_INSIDE} ?\)(?: async)?(?: throws| rethrows)?(?: -> (.*?))?(?: where .*?)?(?: \{{)?$",
        (1, 0, 2, 3, 4),
        rf"{_ANNOTATED}{_SWIFT}(?:let|var) ({_ID})\b.*$",
        named=r"(\w+) ?:",
        exported=lambda mods, name: ~mods.contains("private"),
        lines=True,
    ),
    "typescript": Rules(
        _tokens(r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`", _STRING, _CHARS),
        rf"{_ANNOTATED}((?:(?:export|default|declare|abstract) )*)(class|interface|enum) ({_ID})\b",
        rf"{_ANNOTATED}((?:(?:export|default|declare|async|public|private|protected|static|readonly|override|abstract|get|set) )*)(?:function (?:\* )?|(?:const|let|var) )?(?!(?:if|for|while|switch|catch|return|new|function|super)\b)(?:\* |# ?)?([A-Za-z_$][\w$]*)(?: \?)?(?: < [^(]* >)?(?: : [^=(]*)?(?: = (?:async )?(?:function )?(?:< [^(]* > )?)? ?\( ?{_INSIDE} ?\)(?: : (.*?))?(?: => .*| => \{{| \{{| ;)?$",
        (1, 0, 2, 3, 4),
        rf"{_ANNOTATED}((?:(?:public|private|protected|static|readonly|declare|override|abstract) )*)([A-Za-z_$][\w$]*)(?: [?!])?(?: : .*)?(?: = .*)?(?: ;)?$",
        around=r"^(?:export )?(?:declare )?(?:namespace|module) ()[\w.]+ [{]$",
        named=r"^(?:(?:public|private|protected|readonly) )*(?:\.\.\. ?)?(\w+)",
        exported=lambda mods, name: mods.contains("export"),
        lines=True,
        top=r"\b(?:function|const|let|var)\b.*(?:\bfunction\b|=>|\{$)|\bfunction\b",
    ),
    "scala": Rules(
        _tokens(_LONG, _STRING, r"'(?:\\[^'\n]*|[^'\\\n])'"),
        rf"{_ANNOTATED}{_SC_TYPE}(class|trait|object|enum) ({_ID})\b",
        rf"{_ANNOTATED}{_SC_DEF}def ([A-Za-z_]\w*)(?: \[ .*? \])?(?: \( ?{_INSIDE} ?\))?(?: \(.*?\))*(?: : ([^=]*?))?(?: = .*| =| = \{{| \{{)?$",
        (1, 0, 2, 3, 4),
        rf"{_ANNOTATED}{_SC_VAL}(?:val|var) ({_ID})\b.*$",
        named=r"^(?:implicit |using )?(\w+) ?:",
        exported=lambda mods, name: ~mods.startswith("private"),
        lines=True,
    ),
}
RULES["javascript"] = RULES["tsx"] = RULES["typescript"]
#: Words that a line's beginning, or its end, goes on with.
_GOES_ON, _LEFT_OPEN = [".", "?.", "->", ":", "{", "=", "where", "throws", "&&", "||", ")"], [",", "=", "->", "(", "+", "-", ".", "&&", "||", ":"]
#: Words before a bracket that call nothing.
_NO_CALLS = "if for foreach while switch catch return match when else do in and or not throw case typeof sizeof lock using synchronized guard fn func fun function init await where defer select go super this elseif isset array list unless".split()


def _by(language: Column, make: Callable[[str, Rules], Column | None], otherwise: Column | None = None) -> Column:
    """A column that depends on the language."""
    out = F.lit(None) if otherwise is None else otherwise
    for name, rules in RULES.items():
        if (made := make(name, rules)) is not None:
            out = F.when(language == name, made).otherwise(out)
    return out


def tokens(files: DataFrame) -> DataFrame:
    """``path, language, at, token, line, level, inside``: places from 0, lines from 1; braces and brackets that are open before a token."""
    # files are dealt by path before they are cut, so that no window over their tokens deals those again
    known = files.where(F.col("language").isin(*RULES) & F.col("content").isNotNull()).select("path", "language", "content")
    size = known.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    known = known.repartition(max(1, -(-size // TEXT)), "path")
    found = _by(F.col("language"), lambda _, r: F.regexp_extract_all("content", F.lit(r.tokens), F.lit(0)))
    return nested(known.select("path", "language", F.posexplode(found).alias("at", "token")), ["path", "language"])


def nested(rows: DataFrame, key: list[str], comments: bool = True) -> DataFrame:
    """Lines and open braces and brackets of a table of tokens (``key, at, token``), line feeds and (if there are any) comments left out."""
    before = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    feeds = F.length("token") - F.length(F.replace("token", F.lit("\n")))
    lined = rows.withColumn("line", (1 + F.coalesce(F.sum(feeds).over(before), F.lit(0))).cast("int"))
    comment = F.col("token").rlike(r"^(?://|/\*|<\?|\?>|\n)|^#." if comments else r"^\n")
    step = lambda up, down: F.when(F.col("token").isin(*up), 1).when(F.col("token").isin(*down), -1).otherwise(0)
    open_ = lambda up, down: F.coalesce(F.sum(step(up, down)).over(before), F.lit(0)).cast("int")
    return lined.where(~comment).select(*key, "at", "token", "line", open_(["{"], ["}"]).alias("level"), open_(["(", "["], [")", "]"]).alias("inside"))


def statements(toks: DataFrame) -> DataFrame:
    """``path, language, start, stop, line, last, level, text, braces``: places and lines of each statement's first and last token, its tokens in a row, and its braces (``place, row, pair``: place, line and level)."""
    order = Window.partitionBy("path", "language").orderBy("at")
    prior, above = F.lag("token").over(order), F.lag("line").over(order)
    ended = (prior.isin(";", "{", "}") | (F.col("token") == "}")) & (F.col("inside") == 0)
    by_line = F.col("language").isin(*(n for n, r in RULES.items() if r.lines)) & (F.col("line") > above) & (F.col("inside") == 0) & ~F.col("token").isin(*_GOES_ON) & ~prior.isin(*_LEFT_OPEN)
    begun = toks.withColumn("begins", F.when(prior.isNull() | ended | by_line, 1).otherwise(0)).withColumn("nth", F.sum("begins").over(order))
    held = F.array_sort(F.collect_list(F.struct("at", "token", "line", "level")))
    per = begun.groupBy("path", "language", "nth").agg(held.alias("held"))
    first, last = F.element_at("held", 1), F.element_at("held", -1)
    braces = F.transform(F.filter("held", lambda x: x["token"].isin("{", "}")), lambda x: F.struct(x["at"].alias("place"), x["line"].alias("row"), (x["level"] - F.when(x["token"] == "}", 1).otherwise(0)).alias("pair")))
    return per.select("path", "language", first["at"].alias("start"), last["at"].alias("stop"), first["line"].alias("line"), last["line"].alias("last"), first["level"].alias("level"), F.array_join(F.transform("held", lambda x: x["token"]), " ").alias("text"), braces.alias("braces"))


def _tight(text: Column) -> Column:
    """A type as it is written: blanks between its names only."""
    text = F.regexp_replace(text, r" ?([<>\[\].?*&]|::|->) ?", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\( ", "("), r" \)", ")")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" ?, ?", ", "), r"(?<!:) ?: ?(?!:)", ": "))


def _parameters(text: Column, language: Column) -> Column:
    for _ in range(3):  # what stands in brackets holds no commas that part parameters
        text = F.regexp_replace(text, r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    names = _by(language, lambda _, r: F.transform(parts, lambda x: F.regexp_extract(x, r.named, 1)))
    return F.filter(names, lambda x: x != "")


def declarations(toks: DataFrame) -> DataFrame:
    """``path, language, kind, name, owner, line, last, open, close, exported, params, returns`` of types, functions, signatures and fields, in ``start`` order."""
    lang, text = F.col("language"), F.col("text")
    opens = F.col("text").endswith("{")
    # a statement that opens a block stands for its brace, the other braces for themselves: partners are found, and below blocks around, in one pass over them
    parts = ("language", "start", "stop", "line", "last", "level", "text")
    own = F.struct(F.col("stop").alias("place"), F.col("last").alias("row"), F.when(opens, F.col("level_at_stop")).alias("pair"), F.struct(*parts).alias("own"))
    took = statements(toks).withColumn("level_at_stop", F.try_element_at("braces", F.lit(-1))["pair"])
    other = F.transform(F.filter("braces", lambda x: ~opens | (x["place"] != F.col("stop"))), lambda x: F.struct(x["place"].alias("place"), x["row"].alias("row"), x["pair"].alias("pair"), F.lit(None).cast(took.select(F.struct(*parts).alias("x")).schema["x"].dataType).alias("own")))
    rows = took.select("path", F.inline(F.concat(F.array(own), other)))
    same, whole = Window.partitionBy("path", "pair").orderBy("place"), Window.partitionBy("path")
    rows = rows.select("*", F.lead("place").over(same).alias("close"), F.lead("row").over(same).alias("closed"), F.max("place").over(whole).alias("end_at"), F.max("row").over(whole).alias("end_line"))
    took = rows.where("own is not null").select("path", "own.*", "close", "closed", "end_at", "end_line")
    took = took.withColumn("close", F.when(opens, F.coalesce("close", F.col("end_at") + 1))).withColumn("last", F.when(opens, F.coalesce("closed", "end_line")).otherwise(F.col("last")))
    group = lambda pick: _by(lang, lambda _, r: pick(r))
    got = lambda pattern, k: F.regexp_extract("text", pattern, k) if pattern and k else F.lit("")
    is_type = group(lambda r: text.rlike(r.types))
    is_around = group(lambda r: text.rlike(r.around) if r.around else F.lit(False))
    is_function = group(lambda r: text.rlike(r.functions))
    is_field = group(lambda r: text.rlike(r.fields) if r.fields else F.lit(False))
    kind = F.when(is_type, "class").when(is_around, "around").when(is_function, F.when(text.endswith(";"), "signature").otherwise("function")).when(is_field, "field").otherwise("statement")
    told = took.withColumn("kind", kind)
    name = F.when(F.col("kind") == "class", group(lambda r: got(r.types, 3))).when(F.col("kind") == "around", group(lambda r: got(r.around, 1))).when(F.col("kind").isin("function", "signature"), group(lambda r: got(r.functions, r.parts[2]))).when(F.col("kind") == "field", group(lambda r: got(r.fields, 2)))
    told = told.withColumn("name", F.regexp_replace(F.when((lang == "swift") & F.col("kind").isin("function", "signature") & (name == ""), "init").otherwise(name), " ", ""))
    # the block around a statement is the last one of the level below that was opened before it
    held = F.struct(*[F.col(c) for c in told.columns if c not in ("path", "level")])
    of, frame = told.select(held.alias("x"), F.struct("stop", F.col("kind").alias("what"), F.col("name").alias("whose")).alias("f")).schema.fields
    row = lambda level, place, frame, own: F.struct(level.alias("level"), place.alias("place"), frame.alias("frame"), own.alias("own"))
    statement = row(F.col("level"), F.col("start"), F.lit(None).cast(frame.dataType), held)
    opened = row(F.col("level") + 1, F.col("stop"), F.struct("stop", F.col("kind").alias("what"), F.col("name").alias("whose")), F.lit(None).cast(of.dataType))
    rows = told.select("path", F.inline(F.when(opens, F.array(statement, opened)).otherwise(F.array(statement))))
    upto = Window.partitionBy("path", "level").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("frame", F.last("frame", True).over(upto)).where("own is not null").select("path", "level", "frame", "own.*")
    around = F.when(F.col("level") > 0, F.col("frame.what")).otherwise("top")
    must = group(lambda r: text.rlike(r.top) if r.top else F.lit(True))
    placed = placed.where((around != "top") | ~F.col("kind").isin("function", "signature") | must)
    placed = placed.where((F.col("kind") != "around") & (F.col("kind") != "statement") & around.isin("top", "class", "around") & ((F.col("kind") != "field") | (around == "class")))
    mods = F.when(F.col("kind") == "class", group(lambda r: got(r.types, 1))).when(F.col("kind") == "field", group(lambda r: got(r.fields, 1))).otherwise(group(lambda r: got(r.functions, r.parts[0])))
    own = F.nullif(group(lambda r: got(r.functions, r.parts[1])), F.lit(""))
    owner = F.coalesce(F.when(F.col("kind").isin("function", "signature"), own), F.when(around != "top", F.nullif(F.col("frame.whose"), F.lit(""))))
    callable_ = F.col("kind").isin("function", "signature")
    return placed.select(
        "path", "language", "kind", "name", owner.alias("owner"), "line", "last", "start", F.when(opens, F.col("stop")).alias("open"), "close",
        _by(lang, lambda _, r: r.exported(mods, F.col("name"))).alias("exported"),
        F.when(callable_, _parameters(group(lambda r: got(r.functions, r.parts[3])), lang)).alias("params"),
        F.when(callable_, F.nullif(_tight(group(lambda r: got(r.functions, r.parts[4]))), F.lit(""))).alias("returns"),
    ).where("name != ''")


def calls(toks: DataFrame, declared: DataFrame) -> DataFrame:
    """``path, caller, callee, line``: chains of names before a bracket, inside a function; heads and keywords call nothing."""
    order = Window.partitionBy("path", "language").orderBy("at")
    is_name, is_dot = F.col("token").rlike(r"^[A-Za-z_$\\][\w$\\]*$"), F.col("token").isin(".", "::", "->", "?.", "?->")
    prior = F.lag("token").over(order)
    tied = (is_name & (prior.isin(".", "::", "->", "?.", "?->") | (prior == "new"))) | (is_dot & prior.rlike(r"^[A-Za-z_$\\][\w$\\]*$"))
    linked = toks.select("path", "language", "at", "token", "line", F.lead("token").over(order).alias("next"), prior.alias("prior"), is_name.alias("is_name"), is_dot.alias("is_dot"), F.when(tied, 0).otherwise(1).alias("breaks"))
    linked = linked.withColumn("chain", F.sum("breaks").over(order)).where("is_name or is_dot")
    per = linked.groupBy("path", "language", "chain").agg(F.array_sort(F.collect_list(F.struct("at", "token", "line", "next", "prior"))).alias("held"))
    first, last = F.element_at("held", 1), F.element_at("held", -1)
    text = F.regexp_replace(F.array_join(F.transform("held", lambda x: F.when(x["token"] == "new", "new ").otherwise(x["token"])), ""), r"^(?:\.|::|->|\?\.|\?->)", "")
    made = per.where((last["next"] == "(") & ~F.coalesce(first["prior"].isin("@", "function", "fun", "func", "def", "fn"), F.lit(False))).select("path", "language", first["at"].alias("at"), first["line"].alias("line"), text.alias("callee"))
    made = made.where(~F.col("callee").isin(*_NO_CALLS)).withColumn("callee", F.when(F.col("language") == "kotlin", F.regexp_extract("callee", r"(\w+)$", 1)).otherwise(F.col("callee")))
    bodies = declared.where("kind = 'function' and open is not null").select("path", F.col("name").alias("caller"), "open", "close")
    met = made.join(bodies, "path").where("at > open and at < close")
    return met.groupBy("path", "at", "callee", "line").agg(F.max_by("caller", "open").alias("caller")).select("path", "caller", "callee", "line", "at")
