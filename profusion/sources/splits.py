"""Records of CSV and JSON files of any size, cut in many tasks.

Spark's text source splits a file wherever its separator stands: at line ends for CSV, at ``}`` for JSON. A split cannot tell
from its own bytes whether it begins inside quotes, or how deep in brackets. So a file is read twice:

1. Each split is marked: for either state at its start (outside or inside quotes) the state at its end and by how much the depth
   changes. A running composition over the marks (one row per split) gives the state and depth at each split's start.
2. Each split cuts its own records. Of a record that goes on into further splits each split gives its fragment; fragments of one
   record are put together by a grouping of fragments alone, at most two rows a split.

The records are written once. Their numbers follow from the records per split, again by a running sum over one row per split, so a
file's rows are numbered as one parser that reads it from the start would.

A record of more than ``RECORD_CHARS`` characters is not put together: it gives a row with a reason, keeps its number, and the
records after it stay. (An open quote makes the rest of its file one such record.)

Columns of the result: file, no (from 0), cells (the fields of a CSV row, or the text of a JSON item), reason (null if all is well).
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from profusion.session import shuffle_partitions, written

RECORD_CHARS = 1 << 24
#: Splits whose states are sent to all tasks; beyond it they are joined with a shuffle.
BROADCAST_SPLITS = 1_000_000
#: Characters that a task cuts at a time.
CHUNK = 1 << 22

_MARK = "file string, block long, length long, bytes long, end0 int, end1 int, delta0 long, delta1 long, listed int"
_CUT = "file string, block long, local long, part int, cells array<string>, size long, reason string"
#: Parts of records: whole; begins here and goes on; goes on from before and further; ends here; what may not stand there.
WHOLE, BEGINS, MIDDLE, ENDS, WRONG = range(5)


def valid_text(c: Column) -> Column:
    """UTF-8 without its invalid bytes."""
    return F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit(""))


def pieces(spark: SparkSession, folder: str, pattern: str, separator: str) -> DataFrame:
    """The files of a folder whose names match, in pieces between separators: file, block (where the split begins), length, value.

    The pieces of a split come in order, in one task.
    """
    files = spark.read.option("pathGlobFilter", pattern).text(folder, lineSep=separator)
    meta = lambda c: F.col(f"_metadata.{c}")
    return files.select(meta("file_name").alias("file"), meta("file_block_start").alias("block"), meta("file_size").alias("length"), F.octet_length("value").alias("bytes"), valid_text(F.col("value")).alias("value"))


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """The splits of a task: the key columns' values, and the pieces in batches."""

    def parts() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            names, block = columns[0].dictionary_encode().indices.to_numpy(), columns[1].to_numpy()
            cut = np.flatnonzero((names[1:] != names[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in itertools.pairwise([0, *cut.tolist(), batch.num_rows]):
                yield tuple(c[a].as_py() for c in columns), batch.slice(a, b - a)

    for key, group in itertools.groupby(parts(), lambda x: x[0]):
        yield key, (part for _, part in group)


def _texts(parts: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    return (part.column("value").to_pylist() for part in parts)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _sent(rows: Iterator[tuple], ddl: str, weigh) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if len(held) >= 10_000 or size >= CHUNK:
            yield _batch(held, ddl)
            held, size = [], 0
    if held:
        yield _batch(held, ddl)


class Csv:
    """Lines to rows, as the standard dialect has them."""

    separator = "\n"

    @staticmethod
    def inside_after(line: str, inside: bool) -> bool:
        """Whether a quoted field is open at the end of a line; a carriage return outside quotes ends a row."""
        at, end = 0, len(line)
        while True:
            if inside:
                while (quote := line.find('"', at)) >= 0 and line[quote + 1 : quote + 2] == '"':
                    at = quote + 2
                if quote < 0:
                    return True
                at, inside = quote + 1, False
            elif at < end and line[at] == '"':
                at, inside = at + 1, True
                continue
            after = _FIELD_END.search(line, at)  # quotes after the first character of a field are text
            if not after:
                return False
            at = after.end()

    def mark(self, lists: Iterator[list[str]], first: bool) -> tuple:
        a, b = False, True
        for lines in lists:
            for line in lines:
                if '"' in line:
                    a, b = self.inside_after(line, a), self.inside_after(line, b)
        return int(a), int(b), 0, 0, 1

    def cut(self, lists: Iterator[list[str]], first: bool, inside: bool, depth: int, listed: bool, closed: bool) -> Iterator[tuple]:
        local, size = 0, 0
        open_: list[str] = []  # lines of a record that is not complete, as far as it is not too long
        carried = inside  # it began in an earlier split

        def fragment(part: int) -> tuple:
            return local, part, ["".join(open_)] if size <= RECORD_CHARS else None, size, None

        def complete() -> Iterator[tuple]:
            head = first and not local
            for row in self.rows(done, head):
                yield row, 0, None
                head = False
            done.clear()
            yield from self.finished(open_, size, head)

        for lines in lists:
            done: list[str] = []
            for line in lines:
                if '"' in line:
                    inside = self.inside_after(line, inside)
                if not (inside or size or carried or len(line) > RECORD_CHARS):
                    done.append(line)
                    continue
                size += len(line) + 1
                if size <= RECORD_CHARS:
                    open_.append(line + "\n")
                if inside:
                    continue
                if carried:
                    yield fragment(ENDS)
                else:
                    for row in complete():
                        yield local, WHOLE, *row
                        local += 1
                open_, size, carried = [], 0, False
            for row in self.rows(done, first and not local):
                yield local, WHOLE, row, 0, None
                local += 1
        if carried:
            yield fragment(MIDDLE)
        elif size:
            yield fragment(BEGINS)

    def finished(self, open_: list[str], size: int, head: bool) -> Iterator[tuple]:
        """Cells, size and reason of the rows of a complete text; of one that is too long, the reason alone."""
        if size > RECORD_CHARS:
            yield None, size, f"a row of {size} characters"
        else:
            for row in csv.reader(io.StringIO("".join(open_), newline="")):
                if row or head:
                    yield row, 0, None
                head = False

    @staticmethod
    def rows(lines: list[str], head: bool) -> Iterator[list[str]]:
        """The rows of complete lines; blank ones count only as a file's first."""
        for row in csv.reader(io.StringIO("\n".join(lines) + "\n", newline="")) if lines else ():
            if row or head:
                yield row
            head = False


DAMAGED = "not JSON: an item is damaged"
_FIELD_END = re.compile("[,\r]")
csv.field_size_limit(sys.maxsize)


class Json:
    """Pieces to the texts of the items of a top-level array; any other text is one item."""

    separator = "}"

    def chunks(self, lists: Iterator[list[str]], first: bool, closed: bool = False) -> Iterator[bytes]:
        """The split's bytes, separators put back: one stands before each piece but a file's first, one after its last if ``closed``."""
        held, size = [], 0
        for values in lists:
            for v in values:
                held.append(v if first else "}" + v)
                first = False
                size += len(v) + 1
                if size >= CHUNK and (text := "".join(held)):
                    yield text.encode()
                    held, size = [], 0
        if text := "".join(held) + ("}" if closed else ""):
            yield text.encode()

    @staticmethod
    def scanned(b: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        """The running number of quotes that are not escaped, +1 and -1 at brackets, and whether a backslash is open at the end."""
        quote = b == 34
        back = b == 92
        if escaped or back.any():
            at = np.arange(len(b))
            solid = np.maximum.accumulate(np.where(back, -1, at))  # the last place without a backslash
            run = at - solid + (escaped & (solid < 0))  # backslashes that end here
            before = np.concatenate([[int(escaped)], run[:-1]])
            quote &= before % 2 == 0
            escaped = bool(run[-1] % 2)
        step = ((b == 123) | (b == 91)).astype(np.int8) - ((b == 125) | (b == 93)).astype(np.int8)
        return np.cumsum(quote), step, escaped

    def mark(self, lists: Iterator[list[str]], first: bool) -> tuple:
        quotes, escaped, listed = 0, False, None
        delta = [0, 0]
        for text in self.chunks(lists, first):
            b = np.frombuffer(text, np.uint8)
            count, step, escaped = self.scanned(b, escaped)
            inside = ((count + quotes) & 1).astype(bool)
            delta[0] += int(step[~inside].sum())
            delta[1] += int(step[inside].sum())
            quotes += int(count[-1])
            if listed is None and first and (head := text.lstrip()):
                listed = int(head[:1] == b"[")
        return quotes & 1, 1 - (quotes & 1), delta[0], delta[1], listed

    def cut(self, lists: Iterator[list[str]], first: bool, inside: bool, depth: int, listed: bool, closed: bool) -> Iterator[tuple]:
        local, size, held, escaped, shut = 0, 0, [], False, 0  # shut: how often the item's outermost bracket has closed
        began = not first  # an item is open, from here or from before
        carried = not first  # it is from before
        over = not first and depth == 0  # the array has ended

        def add(text: bytes) -> None:
            nonlocal size
            size += len(text)
            if size <= RECORD_CHARS:
                held.append(text)

        def take(part: int) -> tuple:
            nonlocal size, held, shut
            text = b"".join(held).decode("utf-8", "ignore") if size <= RECORD_CHARS else None
            if part == WHOLE:
                row = local, WHOLE, None if text is None else [text], size, f"an item of {size} bytes" if text is None else None if self.single(text, shut) else DAMAGED
            else:
                row = local, part, None if text is None else [text], size, None
            size, held, shut = 0, [], 0
            return row

        for text in self.chunks(lists, first, closed):
            if not listed:
                add(text)
                continue
            b = np.frombuffer(text, np.uint8)
            count, step, escaped = self.scanned(b, escaped)
            out = ((count & 1) ^ int(inside)) == 0
            step = np.where(out, step, 0)
            level = depth + np.cumsum(step)
            cuts = np.flatnonzero((out & (b == 44) & (level == 1)) | ((step == 1) & (level == 1)) | ((step == -1) & (level == 0)))
            closed_ = np.cumsum((step == -1) & (level == 1))
            at = 0
            for c in cuts.tolist():
                stretch, shut, at = text[at:c], shut + int(closed_[c] - (closed_[at - 1] if at else 0)), c + 1
                if text[c] in b"[{":  # the array begins, or something begins after its end
                    if over or text[c : c + 1] != b"[" or stretch.strip():
                        yield local, WRONG, None, 0, "not JSON: text outside the list"
                    began, carried, over, shut = True, False, False, 0
                    continue
                add(stretch)
                if over or text[c] == 125:
                    yield local, WRONG, None, 0, "not JSON: brackets do not match"
                yield take(ENDS if carried else WHOLE)
                local += not carried
                carried, over = False, text[c] != 44
                began = not over
            if over:
                if text[at:].strip():
                    yield local, WRONG, None, 0, "not JSON: text outside the list"
            else:
                add(text[at:])
                shut += int(closed_[-1] - (closed_[at - 1] if at else 0))
            inside, depth = bool((count[-1] & 1) ^ int(inside)), int(level[-1])
        if not listed:
            yield take(BEGINS if first else MIDDLE)
        elif began and not over:
            yield take(MIDDLE if carried else BEGINS)

    @staticmethod
    def single(text: str, shut: int) -> bool:
        """Whether an item's text can be one value (parsers stop at the end of the first): one closed bracket, or one plain value."""
        text = text.strip(" \t\r\n")
        if text[:1] in ("{", "["):
            return shut == 1 and text[-1] in "}]"
        try:
            return not text or json.loads(text) is not text
        except ValueError:
            return False

    def finished(self, open_: list[str], size: int, head: bool) -> Iterator[tuple]:
        text = "".join(open_)
        if size > RECORD_CHARS:
            yield None, size, f"an item of {size} bytes"
        else:
            b = np.frombuffer(text.encode(), np.uint8)
            count, step, _ = self.scanned(b, False)
            step = np.where(count & 1, 0, step)
            yield [text], 0, None if self.single(text, int(((step == -1) & (np.cumsum(step) == 0)).sum())) else DAMAGED


def starts(marks: DataFrame) -> DataFrame:
    """Of each split: inside and depth at its start, and whether it is the last; of its file: listed, inside and depth at the end.

    A split maps states to states: it keeps them, swaps them, or ends in one whatever it began with. The state after some
    splits is that of the last split of the third kind, swapped as often as splits after it swap.
    """
    by = Window.partitionBy("file").orderBy("block")
    until, all_ = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("file")
    fixed = F.col("end0") == F.col("end1")
    m = marks.withColumn("swaps", F.sum(F.when(~fixed, F.col("end0")).otherwise(0)).over(until))
    m = m.withColumns({"last": F.last(F.when(fixed, F.col("end0")), ignorenulls=True).over(until), "then": F.last(F.when(fixed, F.col("swaps")), ignorenulls=True).over(until)})
    m = m.withColumn("after", (F.coalesce("last", F.lit(0)) + F.col("swaps") - F.coalesce("then", F.lit(0))) % 2)
    m = m.withColumn("inside", F.coalesce(F.lag("after").over(by), F.lit(0)))
    m = m.withColumn("delta", F.when(F.col("inside") == 0, F.col("delta0")).otherwise(F.col("delta1")))
    m = m.withColumn("depth", F.sum("delta").over(until) - F.col("delta"))
    return m.select(
        "file", "block", (F.col("inside") == 1).alias("inside"), "depth", (F.coalesce(F.max("listed").over(all_), F.lit(0)) == 1).alias("listed"), F.sum("delta").over(all_).alias("last_depth"),
        F.max_by("after", "block").over(all_).alias("last_inside"), (F.col("block") == F.max("block").over(all_)).alias("final"),
        # The last separator ends the file: its pieces do not show that.
        ((F.col("block") == F.max("block").over(all_)) & (F.sum("bytes").over(all_) == F.col("length"))).alias("closed"),
    )


def records(df: DataFrame, kind: Csv | Json) -> tuple[DataFrame, DataFrame]:
    """Records of pieces (columns file, no, cells, reason), written; and the states of the splits (``starts``)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (file, block, length), parts in _runs(batches, ["file", "block", "length"]):
                size = 0

                def measured(parts=parts) -> Iterator[pa.RecordBatch]:
                    nonlocal size
                    for part in parts:
                        size += part.num_rows + (pc.sum(part.column("bytes")).as_py() or 0)
                        yield part

                found = kind.mark(_texts(measured()), block == 0)
                yield file, block, length, size, *found

        yield from _sent(rows(), _MARK, lambda row: 100)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["file", "block", "inside", "depth", "listed", "closed"]
        rows = ((file, block, *row) for (file, block, *state), parts in _runs(batches, keys) for row in kind.cut(_texts(parts), block == 0, *state))
        yield from _sent(rows, _CUT, lambda row: 50 + sum(map(len, row[4] or ())))

    marks = written(df.mapInArrow(mark, _MARK), "split-marks")
    states = written(starts(marks), "split-states")
    state = states.select("file", "block", "inside", "depth", "listed", "closed")
    if states.count() <= BROADCAST_SPLITS:
        known = df.select("file", "block", "value").join(F.broadcast(state), ["file", "block"])  # keeps the order of the pieces
    else:
        numbered = df.select("file", "block", "value").withColumn("at", F.monotonically_increasing_id())
        n = shuffle_partitions(df.sparkSession)
        known = numbered.join(state, ["file", "block"]).repartition(n, "file", "block").sortWithinPartitions("file", "block", "at").drop("at")
    cuts = written(known.mapInArrow(cut, _CUT), "split-cuts")
    return numbered_records(cuts, kind), states


def numbered_records(cuts: DataFrame, kind: Csv | Json) -> DataFrame:
    """Whole records and those put together from fragments, numbered through each file."""
    order = Window.partitionBy("file").orderBy("block", F.col("part").desc())  # what ends in a split stands before what begins there
    parts = cuts.filter(F.col("part").isin(BEGINS, MIDDLE, ENDS))
    begun = F.last(F.when(F.col("part") == BEGINS, F.struct("block", "local")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    of = parts.withColumn("begun", begun).groupBy("file", "begun").agg(
        F.min("block").alias("at"), F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("block", F.get("cells", F.lit(0)).alias("text")))).alias("texts"),
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    for i, (cells, size, reason) in enumerate(kind.finished(r["texts"], r["size"], r["block"] == 0 and r["local"] == 0)):
                        yield r["file"], r["block"], r["local"] + i, WHOLE, cells, size, reason

        yield from _sent(rows(), _CUT, lambda row: 50 + sum(map(len, row[4] or ())))

    texts = F.when(F.col("size") <= RECORD_CHARS, F.transform("texts", lambda x: x["text"])).otherwise(F.array().cast("array<string>"))
    lost = of.filter("begun is null").select("file", F.col("at").alias("block"), F.lit(0).cast("long").alias("local"), F.lit(None).cast("array<string>").alias("cells"), F.lit("not JSON: an item without a beginning").alias("reason"))
    put = of.filter("begun is not null").select("file", "begun.block", "begun.local", "size", texts.alias("texts")).mapInArrow(join, _CUT)
    every = written(cuts.filter(F.col("part").isin(WHOLE, WRONG)).unionByName(put).drop("part", "size").unionByName(lost), "split-records")
    counts = every.groupBy("file", "block").agg((F.max("local") + 1).alias("n"))
    before = counts.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return every.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("local")).alias("no"), "cells", "reason")


def csv_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of CSV pieces: file, item (from 0, the header not counted), the named columns (null where a file or row lacks them), reason."""
    rows, _ = records(df, Csv())
    rows = written(rows, "csv-rows")  # so that Spark can split the rows of a large file
    header = rows.filter("no = 0").select("file", F.coalesce("cells", F.array().cast("array<string>")).alias("header"))
    at = lambda c: F.size("header") - F.array_position(F.reverse("header"), c)  # noqa: E731  the last of that name
    cell = lambda c: F.when(F.array_contains("header", F.lit(c)), F.get("cells", at(c).cast("int")))
    return rows.filter("no > 0").join(header, "file").select("file", (F.col("no") - 1).alias("item"), *(cell(c).alias(c) for c in columns), "reason")


def json_items(df: DataFrame) -> DataFrame:
    """Items of JSON pieces: file, item_no, item (VARIANT), reason. A file that is not JSON gives one row, with item_no -1 and the reason."""
    found, states = records(df, Json())
    parsed = written(found.withColumn("blank", F.coalesce(F.get("cells", F.lit(0)).rlike(r"^[ \t\r\n]*$"), F.lit(False))).select("file", "no", "blank", "reason", F.try_parse_json(F.get("cells", F.lit(0))).alias("item")), "json-items")
    judged = parsed.groupBy("file").agg(
        F.count("*").alias("n"), F.count_if("blank").alias("blanks"), F.count_if(F.col("item").isNull() & ~F.col("blank") & F.col("reason").isNull()).alias("bad"),
        F.min(F.when(F.col("reason").startswith("not JSON"), F.col("reason"))).alias("reason"),
    )
    end = states.filter("final").select("file", "listed", (F.col("listed") & ((F.col("last_depth") != 0) | (F.col("last_inside") != 0))).alias("open"))
    empty = F.col("listed") & (F.col("n") == 1) & (F.col("blanks") == 1)
    why = F.coalesce("reason", F.when(F.col("open"), "not JSON: it ends too early"), F.when((F.col("bad") > 0) | ((F.col("blanks") > 0) & ~empty), DAMAGED))
    files = judged.join(end, "file").select("file", why.alias("why"))
    good = parsed.filter("not blank").join(files.filter("why is null").select("file"), "file", "left_semi")
    wrong = files.filter("why is not null").select("file", F.lit(-1).cast("long").alias("item_no"), F.lit(None).cast("variant").alias("item"), F.col("why").alias("reason"))
    return good.select("file", F.col("no").alias("item_no"), "item", "reason").unionByName(wrong)
