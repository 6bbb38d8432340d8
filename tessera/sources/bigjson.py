"""Reader for one large JSON report (S3): a single object whose ``results``
array holds every file and each file's ``entities`` array every span.

The text is read in fragments that end with ``}`` (Spark's text source with
that line separator splits a file at any byte), so one document is the work of
many tasks.  What a fragment means depends on what stands before it, and that
is carried by running values, never by reading in order:

1. the number of quotes before it tells whether it starts inside a string
   (an escape never spans two fragments, as ``\\}`` is none);
2. with that, the number of open brackets and braces tells its depth;
3. with that, the last places where the report, a file record or an entity
   was opened, and the ``results`` and ``entities`` arrays were entered or
   left, name the record and the entity it belongs to.

Then each fragment is cut into the pieces of the report's own fields, of file
records and of entities.  Most entities stand in one fragment and are parsed
where they are; only those cut by a brace inside a string or a nested object
are put together again by a shuffle.  A file that holds a third of all
entities is therefore never gathered in one task: its record carries its own
fields only, and its entities are rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.parallel import fits_one_task, split_for_scan
from .reports import FILE_RECORD, REPORT, SPAN_STRUCT

_MARKS = ("opened", "record", "entity", "results", "entities")
_PIECE = "doc string, kind string, opened long, record long, entity long, seq long, place int, whole boolean, text string"
_LAST = "_pid int, doc string, " + ", ".join(f"{c} long" for c in _MARKS)


def _totals():
    """Of each document of one part's ordered rows (_pid, doc, quotes, steps
    outside and inside a string): rows, quotes, and the depth it adds if the
    part starts outside or inside a string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow
        total = {}
        for batch in batches:
            for p, d, quotes, step, other in zip(*(c.to_pylist() for c in batch.columns)):
                t = total.setdefault((p, d), [0, 0, 0, 0])
                t[2], t[3] = t[2] + (other if t[1] % 2 else step), t[3] + (step if t[1] % 2 else other)
                t[0], t[1] = t[0] + 1, t[1] + quotes
        columns = zip(*((p, d, *t) for (p, d), t in total.items())) if total else [[]] * 6
        kinds = [pyarrow.int32(), pyarrow.string(), *[pyarrow.int64()] * 4]
        yield pyarrow.RecordBatch.from_arrays([pyarrow.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["_pid", "doc", "n", "quotes", "depth", "other"])
    return run


def _earlier() -> WindowSpec:
    """The parts of a document before one."""
    return Window.partitionBy("doc").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)


def _starts(f: DataFrame) -> dict[int, tuple]:
    """By part, the number, the quotes before and the depth that its first
    document goes on with.  Parts follow each other in the order of the
    documents, so no other one does: one small row per part."""
    w = _earlier()
    t = f.select("_pid", "doc", "quotes", "step", "other").mapInArrow(
        _totals(), "_pid int, doc string, n long, quotes long, depth long, other long")
    t = t.withColumn("seq", F.sum("n").over(w)).withColumn("before", F.sum("quotes").over(w))
    t = t.withColumn("depth", F.when(F.coalesce("before", F.lit(0)) % 2 == 0, F.col("depth")).otherwise(F.col("other")))
    t = t.withColumn("depth", F.sum("depth").over(w)).where("seq IS NOT NULL")
    return {r["_pid"]: (r["seq"], r["before"], r["depth"]) for r in t.collect()}


def _walker(results: str, entities: str, piece: str, last: str):
    """Functions that run in Python workers, without names outside them."""
    token = re.compile(r'"(?:[^"\\]|\\.)*(?P<end>"?)|[{}\[\]]', re.S)
    rest = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
    colon = re.compile(r"\s*:\s*")

    def steps(frag, in_string, depth, closes):
        """(place, sign, depth after it, key of an array) of each bracket and
        brace outside strings; the closing brace stands at the end."""
        at, key, key_end = 0, None, 0
        if in_string:
            end = rest.match(frag)
            if end is None:
                return
            at = end.end()
        for m in token.finditer(frag, at):
            sign = m[0]
            if sign[0] == '"':
                if not m["end"]:
                    return  # the fragment ends inside a string
                key, key_end = sign[1:-1], m.end()
                continue
            if sign in "{[":
                depth += 1
                named = key if sign == "[" and key is not None and colon.fullmatch(frag, key_end, m.start()) else None
                yield m.start(), sign, depth, named
            else:
                depth -= 1
                yield m.start(), sign, depth, None
        if closes:
            yield len(frag), "}", depth - 1, None

    def marks(frag, in_string, depth, closes, seq):
        """The fragment's number where it opens a thing, and the last change
        of being inside an array as 2 x number + state, in the order of _MARKS."""
        found = [None] * 5
        for _, sign, depth, key in steps(frag, in_string, depth, closes):
            if sign == "{" and depth in (1, 3, 5):
                found[depth // 2] = seq
            elif depth == 2 and key == results:
                found[3] = 2 * seq + 1
            elif depth == 4 and key == entities:
                found[4] = 2 * seq + 1
            if sign in "]}" and depth <= 3:
                found[4] = 2 * seq
                if depth <= 1:
                    found[3] = 2 * seq
        return found

    def walk(batches: Iterator[pa.RecordBatch], carried: dict, cutting: bool) -> Iterator[pa.RecordBatch]:
        """One part's fragments in order, after the number, quotes, depth and
        marks that its first document starts with: the pieces, or the last
        marks of each of its documents."""
        import pyarrow
        types = {"string": pyarrow.string(), "long": pyarrow.int64(), "int": pyarrow.int32(), "boolean": pyarrow.bool_()}
        schema = pyarrow.schema([(c.split()[0], types[c.split()[1]]) for c in (piece if cutting else last).split(", ")])

        def written(out):
            return pyarrow.RecordBatch.from_arrays(
                [pyarrow.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        fresh = 0, 0, 0, [None] * 5
        doc, pid, (seq, quotes, depth, held) = None, None, fresh
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["doc"] != doc:
                    if doc is not None and not cutting:
                        out.append((pid, doc, *held))
                    seq, quotes, depth, held = carried.get(row["_pid"], fresh) if doc is None else fresh
                    doc, pid = row["doc"], row["_pid"]
                row["in_string"], row["seq"] = quotes % 2 == 1, seq
                if cutting:
                    cut(row, depth, held, out)
                found = marks(row["frag"], row["in_string"], depth, row["closes"], seq)
                held = [y if x is None else x for x, y in zip(found, held)]
                depth += row["other" if row["in_string"] else "step"]
                seq, quotes = seq + 1, quotes + row["quotes"]
            if out:
                yield written(out)
        if doc is not None and not cutting:
            yield written([(pid, doc, *held)])

    def cut(row: dict, depth: int, marks0: list, out: list) -> None:
        """Adds the pieces of a fragment."""
        frag, seq = row["frag"] + "}" * row["closes"], row["seq"]
        opened, record, entity, in_results, in_entities = marks0
        inside, listed = (in_results or 0) % 2 == 1, (in_entities or 0) % 2 == 1

        def kind():
            """What the text at this place belongs to."""
            if depth < 1:
                return None
            if not inside:
                return "report"
            if listed and depth >= 4:
                return "entity" if depth >= 5 else None
            return "file" if depth >= 3 else None

        def put(what, a, b, whole):
            if what and b > a:
                out.append((row["doc"], what, opened, record, entity, seq, a, whole, frag[a:b]))
        now, start, fresh = kind(), 0, False
        for at, sign, after, key in steps(row["frag"], row["in_string"], depth, row["closes"]):
            was, depth = depth, after
            if sign in "{[":
                before, was_inside, was_listed = now, inside, listed
                inside = inside or (after == 2 and key == results)
                listed = listed or (after == 4 and key == entities and inside)
                entered = (inside, listed) != (was_inside, was_listed)
                now = kind()
                if now != before or (sign == "{" and was == 0):
                    # the bracket of an array belongs to what holds the array
                    put(before, start, at + entered, False)
                    start, fresh = at + entered, not entered
                    if sign == "{" and not entered:
                        opened = seq if after == 1 else opened
                        record = seq if after == 3 else record
                        entity = seq if after == 5 else entity
            else:
                left = (listed and after <= 3) or (inside and after <= 1)
                before = now
                listed = listed and after > 3
                inside = inside and after > 1
                now = kind()
                if now != before:
                    end = at + 1 if not left else start
                    put(before, start, end, fresh)
                    start, fresh = (at + 1 if not left else at), False
        put(now, start, len(frag), False)
    return walk


def _fragments(spark: SparkSession, path: str, joined: bool) -> DataFrame:
    """doc, file, block, mid (their order), frag, closes: the text between
    closing braces; ``closes`` is false for a file's tail after the last one."""
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"), F.col("value").alias("frag"), F.col("_metadata.file_size").alias("size"))
    # a file whose bytes are all text and separators ends with a separator
    tail = lines.groupBy("file").agg(F.max(F.struct("block", "mid")).alias("tail"),
                                     (F.sum(F.octet_length("frag") + 1) == F.max("size")).alias("even"))
    doc = F.regexp_replace("file", "/[^/]*$", "") if joined else F.col("file")
    last = F.struct("block", "mid") == F.col("tail")
    return lines.join(tail, "file").select(doc.alias("doc"), "file", "block", "mid", "frag", (~last | F.col("even")).alias("closes"))


def report_pieces(spark: SparkSession, path: str, joined: bool = False, results: str = "results", entities: str = "entities",
                  plain: bool | None = None) -> DataFrame:
    """The report cut into pieces of text: kind (report, file, entity), the
    numbers of the report, record and entity they belong to, and their order."""
    walk = _walker(results, entities, _PIECE, _LAST)
    order = ["file", "block", "mid"]
    f = _fragments(spark, path, joined)
    bare = F.regexp_replace("frag", r"(?s)\\.", "")

    def count(text: Column, *signs: str) -> Column:
        """How often one of the signs stands in a text."""
        return sum(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in signs).cast("long")

    def step(inside: bool) -> Column:
        """What a fragment adds to the depth, if it starts inside a string."""
        signs = F.regexp_replace(F.concat(F.lit('"'), F.col("bare")) if inside else F.col("bare"), r'"[^"]*+("|\z)', "")
        closed = F.col("closes") & ((F.col("quotes") + int(inside)) % 2 == 0)
        return count(signs, "{", "[") - count(signs, "}", "]") - closed.cast("long")
    small = fits_one_task(f) if plain is None else plain
    f = f.withColumn("bare", bare).withColumn("quotes", count(F.col("bare"), '"'))
    # counted once, before the rows are stored
    f = f.withColumn("step", step(False)).withColumn("other", step(True)).drop("bare")
    if small:
        f = f.repartition(1).withColumn("_pid", F.lit(0)).sortWithinPartitions("doc", *order)
    else:
        f = split_for_scan(f, order, ["doc"], ordered=True)
    f = f.select("_pid", "doc", "frag", "closes", "quotes", "step", "other")
    starts, w = _starts(f), _earlier()
    known = {p: (*start, [None] * 5) for p, start in starts.items()}
    last = f.mapInArrow(lambda batches: walk(batches, known, False), _LAST)
    held = last.select("_pid", F.count(F.lit(1)).over(w).alias("n"), *(F.max(c).over(w).alias(c) for c in _MARKS))
    held = {r["_pid"]: (*starts[r["_pid"]], [r[c] for c in _MARKS]) for r in held.where("n > 0").collect()}
    return f.mapInArrow(lambda batches: walk(batches, held, True), _PIECE)


class LargeReport:
    """The parts of a report as tables.

    ``header``: one row per report with its own fields; ``files``: one row per
    file record (``record`` numbers it); ``entities``: one row per entity, with
    the ``record`` it belongs to.  The cut text is written once to ``store``
    and each table reads its own kind.
    """

    def __init__(self, pieces: DataFrame, store: str):
        pieces.write.partitionBy("kind").parquet(store)
        self._pieces = pieces.sparkSession.read.schema(pieces.schema).parquet(store)

    def _parsed(self, kind: str, keys: list[str], schema: T.StructType) -> DataFrame:
        p = self._pieces.where(F.col("kind") == kind).select("doc", "opened", "record", "entity", "seq", "place", "whole", "text")
        texts = p.where("whole").select("doc", *keys, "text")
        parts = p.where("NOT whole").groupBy("doc", *keys).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "place", "text"))), lambda x: x["text"]), "").alias("text"))
        return texts.unionByName(parts).select("doc", *keys, F.from_json("text", schema).alias("r")).select("doc", *keys, "r.*")

    @property
    def header(self) -> DataFrame:
        return self._parsed("report", ["opened"], T.StructType([f for f in REPORT.fields if f.name != "results"]))

    @property
    def files(self) -> DataFrame:
        return self._parsed("file", ["opened", "record"], T.StructType([f for f in FILE_RECORD.fields if f.name != "entities"]))

    @property
    def entities(self) -> DataFrame:
        e = self._parsed("entity", ["opened", "record", "entity"], SPAN_STRUCT)
        return e.select("doc", "opened", "record", F.coalesce("entity_type", F.lit("")).alias("entity_type"),
                        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("text", F.lit("")).alias("text"), "start", "end")


def read_large_report(spark: SparkSession, path: str, joined: bool = False, plain: bool | None = None, **names) -> LargeReport:
    """S3: a report of any size in one JSON document.

    ``joined``: the files of a folder, in the order of their names, form one
    document (what :func:`write_large_report` writes).  A file may also hold
    several documents after each other.  Records and entities that are no
    objects are left out; fields that are missing are null, an entity's type
    and text '' and its score 0.0.  ``plain`` forces a plan for the running
    values, ``names`` the arrays' names.
    """
    from ..session import scratch_path
    import uuid
    return LargeReport(report_pieces(spark, path, joined, plain=plain, **names),
                       scratch_path(spark, f"tessera-pieces-{uuid.uuid4().hex[:12]}"))


def report_lines(header: DataFrame, files: DataFrame, entities: DataFrame) -> DataFrame:
    """``(place, record, entity, line)`` of one JSON document: a line per file
    and per entity, so no row holds a whole file or the whole report.

    ``header``: one row of report fields; ``files``: ``record`` (a unique
    number) and file fields; ``entities``: ``record``, ``entity`` (unique in
    its record) and span fields.
    """
    fields = header.select(F.regexp_replace(F.to_json(F.struct(*header.columns)), r"\}$", "").alias("line"))
    comma = F.when(F.col("line").endswith("{"), F.lit("")).otherwise(F.lit(", "))
    top = fields.select(F.lit(0).alias("place"), F.lit(None).cast("long").alias("record"), F.lit(None).cast("long").alias("entity"),
                        F.concat("line", comma, F.lit('"results": [')).alias("line"))
    end = top.select(F.lit(2).alias("place"), "record", "entity", F.lit("]}").alias("line"))
    first = files.agg(F.min("record")).scalar()
    own = [c for c in files.columns if c != "record"]
    text = F.regexp_replace(F.to_json(F.struct(*own)), r"\}$", "")
    text = F.concat(F.when(F.col("record") == first, F.lit("")).otherwise(F.lit("]}, ")), text, F.lit(', "entities": ['))
    starts = files.select(F.lit(1).alias("place"), F.col("record").cast("long").alias("record"),
                          F.lit(None).cast("long").alias("entity"), text.alias("line"))
    least = entities.groupBy("record").agg(F.min("entity").alias("_first"))
    e = entities.join(least, "record")
    spans = e.select(F.lit(1).alias("place"), F.col("record").cast("long").alias("record"), F.col("entity").cast("long").alias("entity"),
                     F.concat(F.when(F.col("entity") == F.col("_first"), F.lit("")).otherwise(F.lit(", ")), F.to_json(F.struct(
                         *[c for c in entities.columns if c not in ("record", "entity")]))).alias("line"))
    close = files.agg(F.max("record").alias("record")).where("record IS NOT NULL").select(
        F.lit(1).alias("place"), (F.col("record") + 1).cast("long").alias("record"), F.lit(None).cast("long").alias("entity"),
        F.lit("]}").alias("line"))
    return top.union(starts).union(spans).union(close).union(end)


def write_large_report(header: DataFrame, files: DataFrame, entities: DataFrame, path: str) -> None:
    """S8 as one JSON document of any size: its lines are sorted and written
    by many tasks; the part files, in the order of their names, are the
    document (``cat part-*``)."""
    from .sinks import write_lines
    write_lines(report_lines(header, files, entities), path)
