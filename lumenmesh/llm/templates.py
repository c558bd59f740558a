"""Line dedup by a log-template tree.

A line is a list of words; a word with a digit in it is a variable field and parses as one wildcard, if the words compared
have at least as many constants (words with a letter and no digit) as wildcards: rows of numbers have little else than their
values and are compared by these. The tree has a fixed depth: token count, then the leading tokens; a leaf groups the lines that share both. Within a leaf the template
is generalised over one further variable stretch: of the tokens after the leading ones, cut into thirds, all but one third
must agree. A template (a whole masked line, or a leaf with one third left open) recurs if at least MIN_DOCS documents have
it, a whole line of LEAST tokens or more from LONG_DOCS documents on; its lines are then dropped from all documents but the
first one (smallest doc_id), which keeps them.

Unlike an online tree, the result doesn't depend on the order of lines: keys of all lines are made in one pass over the
text, and recurrence is counted by them, hot lines summed before any shuffle.

Lines are equal if two 64-bit keys with different bases are. Drops belong to a doc_id and the prints of its text, so other
texts of the same doc_id lose nothing by them. A very long text is worked through in parts that end with a line.

Defined cases: null texts stay null, empty texts and blank lines stay; lines of a null doc_id are neither counted nor
dropped; a line repeated within one document counts once; rows that share a doc_id count as one document for the
generalised templates and by row for whole lines, of which one with a single doc_id doesn't recur; repeated rows lose the
same lines; other columns pass by, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    _BASE, _BASE_INV, BROADCAST_ROWS, CHUNK_BYTES, _powers, byte_texts, chunks, dealt, mix64, parts, sliced, table, text_print, word_bounds, word_hashes, written,
)

MIN_DOCS, LONG_DOCS = 5, 2
#: Leading tokens that a leaf shares; lines shorter than LEAST tokens have whole-line templates only.
LEAD, LEAST = 4, 10
#: The second keys' base.
_BASE2 = 0x2545F4914F6CDD1D
_BASE2_INV = pow(_BASE2, -1, 1 << 64)
_WILD = np.uint64(0x5851F42D4C957F2D)


def keys_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """For every line with a word: text, line, whole (key), first (no earlier equal line in its text), leaf, and the
    three keys with one third left open; leaf is 0 where the line is short. Each key but the leaf's has a second one, made
    with another base, under its name and a 2: lines count as equal if both are."""
    found = []
    for a, b in chunks(texts):
        if b - a > 1 or len(texts[a]) <= 2 * CHUNK_BYTES:
            found.append(_line_keys(texts[a:b], a, 0))
            continue
        line = 0
        for part in parts(texts[a], ends=b"\n"):
            whole_lines = part[:-1] if part.endswith(b"\n") else part
            found.append(_line_keys([whole_lines], a, line))
            line += whole_lines.count(b"\n") + 1
    out = {c: np.concatenate([f[c] for f in found]) for c in found[0]} if found else _line_keys([b""], 0, 0)
    order = np.lexsort((np.arange(len(out["text"])), out["whole2"], out["whole"], out["text"]))
    new = np.ones(len(order), bool)
    same = [out[c][order][1:] == out[c][order][:-1] for c in ("text", "whole", "whole2")]
    new[1:] = ~(same[0] & same[1] & same[2])
    out["first"] = np.zeros(len(order), bool)
    out["first"][order[new]] = True
    return out


def _line_keys(texts: list[bytes], first_text: int, first_line: int) -> dict[str, np.ndarray]:
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = word_bounds(flat)
    h = word_hashes(flat, starts, ends)
    digits = np.concatenate([[0], np.cumsum((flat >= 48) & (flat <= 57))])
    # ASCII letters and lead bytes of others; C2 and E2 lead signs, dashes and currencies for the most part
    lower = flat | 32
    letters = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122) & (flat < 128) | (flat >= 0xC3) & (flat != 0xE2))])
    wild = digits[ends] > digits[starts]
    excess = np.concatenate([[0], np.cumsum(((letters[ends] > letters[starts]) & ~wild).astype(np.int64) - wild)])
    line_ends = np.flatnonzero(flat == 10)
    of_text = np.cumsum([0, *(len(t) + 1 for t in texts)])
    line_text = np.searchsorted(of_text, line_ends, "right") - 1
    line_no = np.arange(len(line_ends)) - np.searchsorted(line_ends, of_text[:-1])[line_text]
    first = np.searchsorted(starts, np.concatenate([[0], line_ends]))
    lo, hi = first[:-1], first[1:]
    full = np.flatnonzero(hi > lo)
    lo, hi = lo[full], hi[full]
    n = hi - lo
    long = n >= LEAST
    head = lo + np.minimum(LEAD, n)
    cuts = [head + (hi - head) * k // 3 for k in range(4)]
    of_line = excess[hi] - excess[lo]

    def keys(h, base, back):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(base, len(h)), out=total[1:])
        down = _powers(back, len(h) + 1)

        def part(a, b):
            return (total[b] - total[a]) * down[a]

        leaf = np.where(long, mix64(part(lo, head) * np.uint64(3) + n.astype(np.uint64)), np.uint64(0))
        thirds = [
            np.where(long, mix64(mix64(leaf + np.uint64(k + 1)) + mix64(part(head, cuts[k]) + np.uint64(1)) * np.uint64(5) + part(cuts[k + 1], hi)), np.uint64(0))
            for k in range(3)
        ]
        return mix64(part(lo, hi) + n.astype(np.uint64)), leaf, thirds

    out = {"text": line_text[full] + first_text, "line": line_no[full] + first_line}
    for tail, base, back in (("", _BASE, _BASE_INV), ("2", _BASE2, _BASE2_INV)):
        literal, _, literal_thirds = keys(h, base, back)
        masked, leaf, thirds = keys(np.where(wild, _WILD, h), base, back)
        out["whole" + tail] = np.where(of_line >= 0, masked, literal)
        if not tail:
            out["leaf"] = leaf
        for k in range(3):
            out[f"third{k}{tail}"] = np.where(of_line - (excess[cuts[k + 1]] - excess[cuts[k]]) >= 0, thirds[k], literal_thirds[k])
    return out


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, the prints of the text, line (number from 0) and the keys of every line with a word."""
    names = ["whole", "whole2", "leaf", *(f"third{k}{tail}" for k in range(3) for tail in ("", "2"))]

    def run(batches):
        for batch in sliced(batches):
            k = keys_of(byte_texts(batch.column("text")))
            for i in range(0, len(k["text"]), 200_000):
                part = {c: x[i : i + 200_000] for c, x in k.items()}
                at, short = pa.array(part["text"]), part["leaf"] == 0
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c).take(at) for c in ("doc_id", "_p", "_q")}, "line": part["line"].astype(np.int32), "first": part["first"],
                    **{c: pa.array(part[c].view(np.int64), mask=None if c.startswith("whole") else short) for c in names},
                })

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, _p long, _q long, line int, first boolean, " + ", ".join(f"{c} long" for c in names)
    return docs.where("doc_id IS NOT NULL").select("doc_id", *text_print(F.col("text")), "text").mapInArrow(run, schema)


def recurring_lines(docs: DataFrame, min_docs: int | None = None) -> DataFrame:
    """(doc_id, _p, _q, line) of the lines to drop, once each; the prints tell the texts of one doc_id apart. min_docs, where
    given, holds for long lines too."""
    long_docs, min_docs = (LONG_DOCS, MIN_DOCS) if min_docs is None else (min_docs, min_docs)
    keys = written(line_keys(docs), "line-keys")
    row = ["doc_id", "_p", "_q", "line"]
    whole = keys.where("first").groupBy("whole", "whole2").agg(F.count("*").alias("docs"), F.count("leaf").alias("long"), F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"))
    whole = whole.where((F.col("docs") >= F.when(F.col("long") > 0, long_docs).otherwise(min_docs)) & F.expr("keeper <> last"))
    whole = written(whole.select("whole", "whole2", "keeper", F.col("docs").alias("rows")), "line-templates")
    leaves = keys.where("first AND leaf IS NOT NULL").groupBy("leaf").agg(F.count("*").alias("rows"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
    leaves = written(leaves.where((F.col("rows") >= min_docs) & F.expr("lo <> hi")).select("leaf", "rows"), "leaves")
    thirds = F.explode(F.array(*(F.struct(F.col(f"third{k}").alias("third"), F.col(f"third{k}2").alias("third2")) for k in range(3))))
    variants = _among(keys, leaves, ["leaf"]).select(*row, "whole", thirds.alias("open")).select(*row, "whole", "open.*")
    open_ = variants.groupBy("third", "third2").agg(
        F.count_distinct("doc_id").alias("docs"), F.min("doc_id").alias("keeper"), F.min("whole").alias("lo"), F.max("whole").alias("hi"), F.count("*").alias("rows")
    )
    open_ = written(open_.where((F.col("docs") >= min_docs) & F.expr("lo <> hi")).select("third", "third2", "keeper", "rows"), "open-templates")
    dropped = _among(keys, whole, ["whole", "whole2"]).where("doc_id <> keeper").select(*row)
    more = _among(variants, open_, ["third", "third2"]).where("doc_id <> keeper").select(*row)
    return dropped.unionByName(more).distinct()


def _among(lines: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """lines of the templates, which have the number of their `rows`: by a broadcast of few, else dealt over the tasks."""
    if templates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(templates.drop("rows")), keys)
    return dealt(lines, templates.drop("rows"), keys, templates, "_p")


def drop_templates(docs: DataFrame, min_docs: int | None = None) -> DataFrame:
    """The rows of docs, their text without recurring lines; appended last: n_lines and n_dropped (or, where docs has such
    columns, the same with underscores before). Rows of a null doc_id pass by; others meet their lines by doc_id and the
    prints of their text."""
    total, lost = "n_lines", "n_dropped"
    while {total, lost} & {c.lower() for c in docs.columns}:
        total, lost = f"_{total}", f"_{lost}"
    drops = recurring_lines(docs, min_docs).groupBy("doc_id", "_p", "_q").agg(F.collect_list("line").alias("gone"))
    # the row itself stays one column, so that no name of docs clashes with ours
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    keyed = held.where("d.doc_id IS NOT NULL").select("d", F.col("d.doc_id").alias("doc_id"), *text_print(F.col("d.text")))
    joined = keyed.join(drops, ["doc_id", "_p", "_q"], "left").select("d", "gone")
    joined = joined.unionByName(held.where("d.doc_id IS NULL").withColumn("gone", F.lit(None).cast("array<int>")))
    lines = F.split(F.col("d.text"), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(F.array_join(F.transform(kept, lambda i: lines[i]), "\n"))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in docs.columns),
        F.when(F.col("d.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(total),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(lost),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return drop_templates(docs.select("doc_id", "text"))
