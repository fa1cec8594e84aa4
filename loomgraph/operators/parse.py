"""Line-based text parsers as column expressions and windows; no Python in the rows' path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_count(content: Column) -> Column:
    """Line feeds, as ``wc -l`` counts them."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n")))).cast("long")


def lines(files: DataFrame) -> DataFrame:
    """``path, line (from 1), text``."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _ends(found: DataFrame, totals: DataFrame) -> DataFrame:
    """A section ends before the next one, the last at the file's end."""
    nxt = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    return found.withColumn("next", nxt).join(totals, "path").select(*found.columns, F.coalesce(F.col("next") - 1, "total").alias("end")).withColumnRenamed("line", "start")


def _totals(files: DataFrame) -> DataFrame:
    return files.select("path", F.size(F.split("content", "\n")).alias("total"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """``path, start, name, level, end``: ATX headings outside fences."""
    fence = F.when(F.col("text").rlike(r"^\s*(```|~~~)"), 1).otherwise(0)
    inside = F.sum(fence).over(Window.partitionBy("path").orderBy("line"))
    marked = lines(files).withColumn("inside", inside % 2).where("inside = 0 and text rlike '^#{1,6}\\\\s+'")
    found = marked.select("path", "line", F.trim(F.regexp_extract("text", r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)).alias("name"), F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"))
    return _ends(found, _totals(files))


def markdown_references(files: DataFrame) -> DataFrame:
    """``path, target, kind``: links and images that stay inside."""
    link = F.explode(F.regexp_extract_all("content", F.lit(r"(!?\[[^\]]*\]\([^)\s]+)"), 1)).alias("m")
    found = files.select("path", link).select("path", F.regexp_extract("m", r"\(([^)\s]+)$", 1).alias("target"), F.when(F.col("m").startswith("!"), "image").otherwise("link").alias("kind"))
    return found.where("target not rlike '^https?:'")


def toml_sections(files: DataFrame) -> DataFrame:
    """``path, start, name, level, end``: tables and arrays of tables."""
    name = F.regexp_extract("text", r"^\s*\[{1,2}([^\[\]]+)\]{1,2}\s*(?:#.*)?$", 1)
    found = lines(files).select("path", "line", F.trim(name).alias("name")).where("name != ''").withColumn("level", F.size(F.split("name", r"\.")))
    return _ends(found, _totals(files))


def env_variables(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("text", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    return lines(files).where("text not rlike '^\\\\s*#'").select("path", "line", name.alias("name")).where("name != ''")


def dockerfile_stages(files: DataFrame) -> DataFrame:
    """``path, stage, name, ports``: each FROM opens a stage; EXPOSE adds its ports."""
    begin = F.when(F.col("text").rlike(r"(?i)^\s*FROM\s+"), 1).otherwise(0)
    marked = lines(files).withColumn("stage", F.sum(begin).over(Window.partitionBy("path").orderBy("line"))).where("stage > 0")
    image, alias = F.regexp_extract("text", r"(?i)^\s*FROM\s+(?:--\S+\s+)?(\S+)", 1), F.regexp_extract("text", r"(?i)\sAS\s+(\S+)", 1)
    base = F.regexp_extract(image, r"([^/:]+)(?::[^/]*)?$", 1)
    name = F.when(begin == 1, F.when(alias != "", alias).otherwise(base))
    ports = F.transform(F.regexp_extract_all(F.when(F.col("text").rlike(r"(?i)^\s*EXPOSE\s"), F.col("text")).otherwise(""), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))
    per = marked.groupBy("path", "stage").agg(F.max(name).alias("name"), F.flatten(F.collect_list(ports)).alias("ports"))
    return per


def make_targets(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("text", r"^([A-Za-z0-9_][A-Za-z0-9_./-]*)\s*:(?![=])", 1)
    return lines(files).where("text not rlike '^[^:]*[:?]='").select("path", "line", name.alias("name")).where("name != ''")


def sql_tables(files: DataFrame) -> DataFrame:
    """``path, name, kind`` of CREATE TABLE, VIEW and INDEX."""
    found = F.explode(F.regexp_extract_all("content", F.lit(r"(?i)(CREATE\s+(?:OR\s+REPLACE\s+)?(?:UNIQUE\s+)?(?:TABLE|VIEW|INDEX)\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?\w+)"), 1)).alias("m")
    return files.select("path", found).select("path", F.regexp_extract("m", r"(\w+)$", 1).alias("name"), F.lower(F.regexp_extract("m", r"(?i)\b(TABLE|VIEW|INDEX)\b", 1)).alias("kind"))


def wikilinks(files: DataFrame) -> DataFrame:
    """``path, target`` of ``[[target]]`` and ``[[target|label]]``."""
    return files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)).alias("target")).withColumn("target", F.trim("target"))


def index_categories(files: DataFrame) -> DataFrame:
    """``path, category, target``: wikilinks under the nearest ``##`` heading above."""
    head = F.when(F.col("text").rlike(r"^##\s+"), F.trim(F.regexp_extract("text", r"^##\s+(.*)$", 1)))
    marked = lines(files).withColumn("category", F.last(head, True).over(Window.partitionBy("path").orderBy("line")))
    links = F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|]+)"), 1)).alias("target")
    return marked.where("category is not null").select("path", "category", links)


def log_entries(files: DataFrame) -> DataFrame:
    """``path, day, operation, title`` of ``## [YYYY-MM-DD] operation | title``."""
    pattern = r"^##\s*\[(\d{4}-\d{2}-\d{2})\]\s*([^|]+?)\s*\|\s*(.*?)\s*$"
    return lines(files).where(F.col("text").rlike(pattern)).select("path", *[F.regexp_extract("text", pattern, i).alias(c) for i, c in enumerate(("day", "operation", "title"), 1)])


def frontmatter(content: Column) -> Column:
    """The block between leading ``---`` lines as a map of plain keys."""
    block = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.regexp_extract_all(block, F.lit(r"(?m)^([\w-]+:[^\n]*)$"), 1)
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(F.split(p, ":", 2)[0]), F.trim(F.split(p, ":", 2)[1]))))


def concepts(text: Column, keywords: list[str]) -> Column:
    """The keywords that a text holds, in lower case."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(k), F.lit(k)) for k in keywords]))


def json_block(text: Column) -> Column:
    """The JSON of a model's answer: a fenced block, else the first object or list."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n(.*?)\n?```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.try_parse_json(F.when(fenced != "", fenced).otherwise(bare))


def _exports_go(name: Column) -> Column:
    return name.rlike("^[A-Z]")


#: Declarations by language, as patterns of one line: functions, classes, imports.
DECLARATIONS = {
    "python": (r"^(?:async\s+)?def\s+(\w+)", r"^class\s+(\w+)", r"^(?:from\s+(\S+)\s+import|import\s+(\S+))"),
    "typescript": (r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", r"^import\b.*?['\"]([^'\"]+)['\"]"),
    "go": (r"^func\s+(?:\([^)]*\)\s*)?(\w+)", r"^type\s+(\w+)\s+(?:struct|interface)\b", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    "rust": (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", r"^\s*(?:pub\s+)?use\s+([^;]+);"),
    "java": (r"^\s+(?:public|protected|private)[\w<>\[\],\s]*?\s(\w+)\s*\([^;]*$", r"^\s*(?:public\s+|final\s+|abstract\s+)*(?:class|interface|enum|record)\s+(\w+)", r"^import\s+(?:static\s+)?([\w.*]+);"),
    "ruby": (r"^\s*def\s+((?:self\.)?\w+[?!]?)", r"^\s*(?:class|module)\s+(\w+)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]"),
}


def declarations(files: DataFrame, language: str) -> DataFrame:
    """``path, line, kind, name, exported`` by patterns of one line (lower fidelity than a syntax tree)."""
    out = None
    for kind, pattern in zip(("function", "class", "import"), DECLARATIONS[language], strict=True):
        name = F.regexp_extract("text", pattern, 1)
        if language == "python" and kind == "import":
            name = F.when(name == "", F.regexp_extract("text", pattern, 2)).otherwise(name)
        if language == "go":
            exported = _exports_go(name)
        elif language == "rust":
            exported = F.col("text").rlike(r"^\s*pub\b")
        elif language == "java":
            exported = F.col("text").rlike(r"^\s*public\b")
        elif language == "typescript":
            exported = F.col("text").rlike(r"^export\b")
        else:
            exported = F.lit(True)
        one = lines(files).select("path", "line", F.lit(kind).alias("kind"), F.trim(name).alias("name"), (exported & F.lit(kind != "import")).alias("exported")).where("name != ''")
        out = one if out is None else out.unionByName(one)
    return out


def dockerfile_steps(files: DataFrame) -> DataFrame:
    """``path, line, name``: instructions other than FROM and EXPOSE, 60 characters of each."""
    word = F.regexp_extract("text", r"(?i)^\s*(RUN|CMD|ENTRYPOINT|COPY|ADD|WORKDIR|ENV|ARG|USER|VOLUME|HEALTHCHECK|LABEL)\s+(.*)$", 1)
    return lines(files).where(word != "").select("path", "line", F.substring(F.trim("text"), 1, 60).alias("name"))


def sql_columns(files: DataFrame) -> DataFrame:
    """``path, table, name`` of the columns of CREATE TABLE statements, up to the closing bracket and semicolon."""
    pattern = r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?\w+[`\"]?\s*\(.*?\)\s*;"
    found = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), 0)).alias("m"))
    name = F.regexp_extract("m", r"(?is)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?(\w+)", 1)
    body = F.regexp_replace(F.regexp_replace("m", r"(?s)^[^(]*\(", ""), r"(?s)\)\s*;$", "")
    part = F.explode(F.split(F.regexp_replace(body, r"\([^()]*\)", ""), ",")).alias("c")
    column = F.regexp_extract("c", r"^\s*[`\"]?(\w+)", 1)
    rest = found.select("path", name.alias("table"), part).select("path", "table", column.alias("name"))
    return rest.where("name != '' and upper(name) not in ('PRIMARY', 'FOREIGN', 'UNIQUE', 'CHECK', 'CONSTRAINT', 'INDEX', 'KEY')")


def wiki_text(pages: DataFrame) -> DataFrame:
    """``path, title, paragraph`` (200 characters of the first one), ``headings, languages`` of code fences, ``links`` without repeats."""
    body = F.regexp_replace("content", r"(?s)^---\n.*?\n---\n?", "")
    title = F.regexp_extract(body, r"(?m)^#\s+(.+?)\s*$", 1)
    blocks = F.filter(F.transform(F.split(F.regexp_replace(body, r"(?s)```.*?```", ""), r"\n\s*\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^(#|>|[-*|])"))
    headings = F.regexp_extract_all(body, F.lit(r"(?m)^#{2,6}\s+(.+?)\s*$"), 1)
    code = F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?m)^```(\w+)"), 1))
    links = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|]+)"), 1), lambda x: F.trim(x)))
    return pages.select("path", title.alias("title"), F.substring(F.coalesce(F.get(blocks, F.lit(0)), F.lit("")), 1, 200).alias("paragraph"), headings.alias("headings"), code.alias("languages"), links.alias("links"))


def file_answer(text: Column) -> Column:
    """A model's answer about a file as ``struct(summary, tags, complexity)``: fields of a wrong kind take their defaults."""
    doc = json_block(text)
    size = F.try_variant_get(doc, "$.complexity", "string")
    return F.struct(
        F.coalesce(F.try_variant_get(doc, "$.summary", "string"), F.lit("")).alias("summary"),
        F.coalesce(F.try_variant_get(doc, "$.tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.when(size.isin("simple", "moderate", "complex"), size).otherwise("moderate").alias("complexity"),
    )


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/]+)", 1)


def link_extension(href: Column) -> Column:
    """Lower case, without the dot; empty without one."""
    return F.lower(F.regexp_extract(href, r"\.([A-Za-z0-9]+)$", 1))
