"""Graph documents: JSON files of any size, read by blocks in many tasks and written by parts.

A document is one JSON object whose arrays (nodes, edges, layers, tour, ...) hold objects.  No task can tell from the middle
of a file whether it stands in a string or how deep, so a file is read twice.  First every block of bytes tells, for
each of the three states it may begin in (outside strings, inside one, after a backslash in one), the state it ends in and how many
levels it opens; composing these, one after the other, gives every block's true beginning (a few numbers a block).  Then every block
cuts out the elements that begin in it, reading on into the next block where the last of them goes on.

Both readings are data sources of Spark (``graph_blocks``, ``graph_elements``), a partition a run of blocks; ``graph_document`` is the sink.
A filter on ``part`` is pushed to the source: elements of other parts are passed over without being made rows.

Defined cases: an empty file has no elements; a file that is cut off has those that end; a key whose value is no array
is an element of its own (of the same part); files are in the order of their names.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

#: Bytes of a file that are read as one.
BLOCK = 16 << 20
#: Bytes of blocks that one task takes, one after the other, where blocks are smaller.
RUN = 16 << 20
#: Runs (about, at least) that blocks are dealt to, if they are as many.
LEAST = 64
#: Bytes that a task reads on at a time, beyond its block.
MORE = 1 << 20

_TOKEN = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|["{}\[\]]', re.S)
_REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
OUTSIDE, INSIDE, ESCAPED = range(3)
ELEMENT = "file string, k int, nth int, part string, raw string"


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def list_files(path: str) -> list[tuple[str, int]]:
    """Names and sizes of a document, or of the JSON files of a folder, in order."""
    from pyarrow import fs

    scheme = path[: path.index("://") + 3] if "://" in path else "file:" if path.startswith("file:") else ""
    system, inner = fs.FileSystem.from_uri(path) if scheme else (fs.LocalFileSystem(), path)
    info = system.get_file_info(inner)
    found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.is_file and x.path.endswith(".json") and not x.base_name.startswith(("_", "."))]
    return sorted((f"{scheme}{x.path}" if scheme else x.path, x.size) for x in found)


def _end_of_string(data: bytes, at: int) -> int:
    """The state at the end of data that stands in a string from at on."""
    slashes = len(data) - len(data[at:].rstrip(b"\\")) - at if data[at:] else 0
    return ESCAPED if slashes % 2 else INSIDE


def _begin(data: bytes, state: int) -> int:
    """The place where a string that data begins in has ended; -1 if it does not end."""
    at = 1 if state == ESCAPED else 0
    if state == OUTSIDE:
        return 0
    m = _REST.match(data, at)
    return m.end() if m else -1


def transition(data: bytes, state: int) -> tuple[int, int]:
    """The state at the end of a block, and the levels that it opens, if it begins in a state."""
    if not data:
        return state, 0
    at = _begin(data, state)
    if at < 0:
        return _end_of_string(data, 1 if state == ESCAPED else 0), 0
    depth = 0
    for m in _TOKEN.finditer(data, at):
        token = m[0]
        if token == b'"':
            return _end_of_string(data, m.end()), depth
        depth += 1 if token in b"{[" else -1 if token in b"}]" else 0
    return OUTSIDE, depth


def cut_elements(data: bytes, size: int, state: int, depth: int, more) -> Iterator[tuple[str | None, bytes]]:
    """Parts and bytes of the elements that begin within size bytes; part is null where its key stands before the block.

    ``more()`` gives the bytes that follow, or none.  A key at the top is told by an element without bytes.
    """
    while (at := _begin(data, state)) < 0:
        if not (extra := more()):
            return
        data += extra
    part, begin, deep = None, None, None
    while True:
        m = _TOKEN.search(data, at)
        if m is None or m[0] == b'"':  # what comes may be cut off
            if m is None and begin is None and len(data) >= size:
                return
            extra = more()
            if not extra:
                return
            data += extra
            continue
        token, at = m[0], m.end()
        if begin is None and m.start() >= size:
            return
        if token[:1] == b'"':
            if depth == 1 and begin is None:
                tail = re.compile(rb"\s*:\s*").match(data, at)
                while tail is None or tail.end() >= len(data):
                    if not (extra := more()):
                        break
                    data += extra
                    tail = re.compile(rb"\s*:\s*").match(data, at)
                if tail is not None and tail.end() < len(data):
                    part, at = json.loads(token), tail.end()
                    yield part, b""
                    if data[at : at + 1] not in (b"{", b"["):  # a plain value, up to what ends it
                        plain = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|[^\s,}\]"]+(?=[\s,}\]])', re.S)
                        while (value := plain.match(data, at)) is None:
                            if not (extra := more()):
                                return
                            data += extra
                        yield part, value[0]
                        at = value.end()
        elif token in b"{[":
            if begin is None and ((depth == 2 and token == b"{") or (depth == 1 and token == b"{")):
                begin, deep = m.start(), depth
            depth += 1
        else:
            depth -= 1
            if begin is not None and depth == deep:
                yield part, data[begin:at]
                begin = None


class _Block(InputPartition):
    def __init__(self, file: str, k: int, start: int, length: int, state: int = 0, depth: int = 0) -> None:
        self.file, self.k, self.start, self.length, self.state, self.depth = file, k, start, length, state, depth


class _Run(InputPartition):
    def __init__(self, blocks: list[_Block]) -> None:
        self.blocks = blocks


def runs(blocks: list[_Block]) -> list[_Run]:
    """Blocks in order, by runs of about RUN bytes, or of a LEAST-th of all where that is less; so the tasks' number does not follow the blocks'."""
    out: list[_Run] = []
    most = min(RUN, sum(b.length for b in blocks) / LEAST)
    size = most
    for b in blocks:
        if size + b.length > most:
            out.append(_Run([]))
            size = 0
        out[-1].blocks.append(b)
        size += b.length
    return out


class BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.block = options["path"], int(options.get("block", BLOCK))

    def partitions(self) -> list[_Run]:
        return runs([_Block(f, k, at, min(self.block, size - at)) for f, size in list_files(self.path) for k, at in enumerate(range(0, size, self.block))])

    def read(self, partition: _Run) -> Iterator[tuple]:
        for b in partition.blocks:
            with _open(b.file) as f:
                f.seek(b.start)
                data = f.read(b.length)
            told = [x for s in (OUTSIDE, INSIDE, ESCAPED) for x in transition(data, s)]
            yield (b.file, b.k, b.start, b.length, *told)


class BlockSource(DataSource):
    """What each block of a document's bytes does to the state it begins in."""

    @classmethod
    def name(cls) -> str:
        return "graph_blocks"

    def schema(self) -> str:
        return "file string, k int, start long, length long, s0 int, d0 int, s1 int, d1 int, s2 int, d2 int"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options)


class ElementReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.blocks, self.keys = json.loads(options["blocks"]), options.get("keys") == "true"
        self.part: str | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": []}  # a task gets its own blocks, not all of them

    def pushFilters(self, filters):  # noqa: N802
        for x in filters:
            if isinstance(x, EqualTo) and x.attribute == ("part",):
                self.part = x.value
            yield x  # the keys before a block are known after it has been read, so the filter is applied again

    def partitions(self) -> list[_Run]:
        return runs([_Block(*x) for x in self.blocks])

    def read(self, partition: _Run) -> Iterator[tuple]:
        for b in partition.blocks:
            with _open(b.file) as f:
                f.seek(b.start)
                data = f.read(b.length)
                for nth, (part, raw) in enumerate(cut_elements(data, b.length, b.state, b.depth, lambda: f.read(MORE))):
                    if not raw or (not self.keys and (self.part is None or part is None or part == self.part)):
                        yield (b.file, b.k, nth, part, raw.decode() if raw else None)


class ElementSource(DataSource):
    """The elements that begin in each block."""

    @classmethod
    def name(cls) -> str:
        return "graph_elements"

    def schema(self) -> str:
        return ELEMENT

    def reader(self, schema) -> ElementReader:
        return ElementReader(self.options)


class _Written(WriterCommitMessage):
    def __init__(self, path: str) -> None:
        self.path = path


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, iterator) -> _Written:
        """One task's rows (``part, raw``, sorted by part) as a document of its own."""
        from pyarrow import fs
        from pyspark import TaskContext

        system, inner = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/document-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.json"
        held = None
        with system.open_output_stream(name) as out:
            out.write(b"{")
            for row in iterator:
                if not row.raw.startswith("{") or row.part in ("meta", "project"):
                    out.write((("]" if held else "") + ("," if held is not None else "") + json.dumps(row.part) + ":" + row.raw).encode())
                    held = ""
                    continue
                if row.part != held:
                    out.write((("]" if held else "") + ("," if held is not None else "") + json.dumps(row.part) + ":[\n").encode())
                    held = row.part
                else:
                    out.write(b",\n")
                out.write(row.raw.encode())
            out.write(b"]}" if held else b"}")
        return _Written(name)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph_document"

    def writer(self, schema, overwrite) -> DocumentWriter:
        return DocumentWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (BlockSource, ElementSource, DocumentSink):
        spark.dataSource.register(source)


def composed(blocks: list) -> list[list]:
    """The blocks of files with the state and depth that each truly begins in."""
    out, state, depth, file = [], OUTSIDE, 0, None
    for b in sorted(blocks, key=lambda b: (b.file, b.k)):
        if b.file != file:
            file, state, depth = b.file, OUTSIDE, 0
        out.append([b.file, b.k, b.start, b.length, state, depth])
        state, depth = (b.s0, b.s1, b.s2)[state], depth + (b.d0, b.d1, b.d2)[state]
    return out


def read_document(spark: SparkSession, path: str, part: str | None = None, block: int = BLOCK) -> DataFrame:
    """``file, part, ord, raw`` of all elements of a document or a folder of them, or of one part; ``ord`` follows files and places."""
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    plan = composed(spark.read.format("graph_blocks").option("block", block).load(path).collect())  # a few numbers a block
    if not plan:
        return spark.createDataFrame([], "file string, part string, ord long, raw string")
    elements = spark.read.format("graph_elements").option("blocks", json.dumps(plan))
    found = elements.load(path)
    keys = elements.option("keys", "true").load(path).where("raw is null").groupBy("file", "k").agg(F.max_by("part", "nth").alias("last"))
    every = spark.createDataFrame([(x[0], x[1]) for x in plan], "file string, k int").join(keys, ["file", "k"], "left")
    names = {f: n for n, f in enumerate(sorted({x[0] for x in plan}))}
    numbers = spark.createDataFrame(list(names.items()), "file string, nth_file long")
    inherited = every.select("file", "k", F.last("last", True).over(Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)).alias("before")).join(numbers, "file")
    own = found if part is None else found.where((F.col("part") == part) | F.col("part").isNull())
    met = own.where("raw is not null").join(F.broadcast(inherited), ["file", "k"])  # a row a block
    rows = met.select("file", F.coalesce("part", "before").alias("part"), (F.shiftleft("nth_file", 44) + F.shiftleft(F.col("k").cast("long"), 26) + F.col("nth")).alias("ord"), "raw")
    return rows if part is None else rows.where(F.col("part") == part)


def write_document(elements: DataFrame, path: str) -> None:
    """``part, ord, raw`` as documents of one folder, one a partition, each whole in itself; what is no array (``meta``, plain values) goes as it is."""
    register(elements.sparkSession)
    dealt = elements.repartitionByRange(F.col("ord")).sortWithinPartitions("part", "ord")
    dealt.select("part", "raw").write.format("graph_document").mode("append").save(path)


def batch_report(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``file, issue`` of a folder of batch files: names that are no batch's, batches without nodes and edges, numbers that no file has."""
    names = [f for f, _ in list_files(path)]
    files = spark.createDataFrame([(f,) for f in names], "file string")
    base = F.regexp_extract("file", r"([^/]+)$", 1)
    known = base.rlike(r"^batch-(?:\d+(?:-part-\d+)?|existing)\.json$")
    counted = read_document(spark, path, block=block).where("part in ('nodes', 'edges')").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    unknown = files.where(~known).select("file", F.lit("unknown name").alias("issue"))
    empty = files.where(known).join(counted, "file", "left_anti").select("file", F.lit("empty batch").alias("issue"))
    number = F.regexp_extract(base, r"^batch-(\d+)", 1).try_cast("int")
    spans = files.select(number.alias("k")).where("k is not null").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a is not null")
    gaps = spans.select(F.explode(F.sequence("a", "b")).alias("k")).join(files.select(number.alias("k")), "k", "left_anti")
    return unknown.unionByName(empty).unionByName(gaps.select(F.format_string("batch-%d.json", "k").alias("file"), F.lit("missing number").alias("issue")))
