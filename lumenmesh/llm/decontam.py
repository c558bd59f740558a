"""Benchmark decontamination by spaced-seed hashing; DataFrame operations only.

Texts become lower-case runs of letters and digits. Two fixed masks over 10 tokens, of which they look at 6, are hashed at
every position of documents and benchmark items; equal hashes are hits. Around a hit, up to 16 tokens of the item (the
masked window and 3 tokens on both sides, as far as the item goes) are compared in place with the document: the overlap
counts if at least 75 % of them are equal, and at least 10 were compared, so substituted tokens are tolerated.

The benchmark's windows are broadcast after their number has been checked; beyond the bound the same hits come from a
shuffled join, in which seeds that very many positions share are dealt over several tasks. In the broadcast plan the hashes
are made and probed within one generated loop over the tokens of a document.

Defined cases: null and empty texts, and texts and items under 10 tokens, have no window and match nothing; a very long text
is one array of tokens, in memory by a few times its size; repeated items are compared once and reported each; of several
texts of a doc_id, a null one too, the best overlap is reported, each text being compared by itself; of equally good
overlaps there is one row; repeated rows of a document give the same result once; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, small, table, text_print, written

MASKS = ((0, 1, 3, 6, 7, 9), (0, 2, 3, 4, 8, 9))
SPAN = 10
#: Tokens compared on both sides of a window; share of the compared that must be equal; fewest compared.
AROUND, SHARE, LEAST = 3, 0.75, 10
REGION = SPAN + 2 * AROUND
#: Benchmark windows, of at most 16 tokens each, that are broadcast.
BROADCAST_WINDOWS = 200_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def seeds(of: str, at: str) -> Column:
    """The hash of every mask at a position."""
    return F.array(*(F.xxhash64(F.lit(m), *(F.col(of)[F.col(at) + o] for o in mask)) for m, mask in enumerate(MASKS)))


def positions(of: str) -> Column:
    return F.explode(F.when(F.size(of) >= SPAN, F.sequence(F.lit(0), F.size(of) - SPAN)))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """seed, item (number of a distinct token sequence), the tokens to compare, and where the window is in them."""
    found = items.select(tokens(F.col("text")).alias("toks")).where(F.size("toks") >= SPAN).distinct()
    at = found.select("toks", F.xxhash64("toks").alias("item")).select("toks", "item", positions("toks").alias("at"))
    lo = F.greatest(F.lit(0), F.col("at") - AROUND)
    region = F.slice("toks", lo + 1, F.col("at") + SPAN + AROUND - lo)
    return at.select(F.explode(seeds("toks", "at")).alias("seed"), "item", region.alias("region"), (F.col("at") - lo).alias("lead"))


def document_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, the prints of the text, and its tokens; texts without a window are left out."""
    return docs.select("doc_id", *text_print(F.col("text")), tokens(F.col("text")).alias("doc_toks"))


def document_windows(toks: DataFrame) -> DataFrame:
    at = toks.select("doc_id", "_p", "_q", "doc_toks", positions("doc_toks").alias("pos"))
    return at.select("doc_id", "_p", "_q", "doc_toks", "pos", F.explode(seeds("doc_toks", "pos")).alias("seed"))


def _rank() -> Column:
    """One number that orders hits by the equal share, then the number of equal tokens; it holds both counts in its low
    bits. Plain array look-ups instead of lambdas keep it inside the generated loop; null where too little is compared."""
    off = F.col("pos") - F.col("lead")
    same = sum(F.coalesce((F.get("doc_toks", off + j) == F.get("region", F.lit(j))).cast("int"), F.lit(0)) for j in range(REGION))
    inside = F.least(F.size("region"), F.size("doc_toks") - off) - F.greatest(F.lit(0), -off)
    exact = F.expr(f"{math.lcm(*range(1, REGION + 1))}L")
    return F.when(inside >= LEAST, (F.floor(same * exact / inside) * 1024 + same * 32 + inside).cast("long"))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, compared, similarity): the best confirmed overlap of each document and item."""
    windows, toks = benchmark_windows(items), document_tokens(docs)
    if windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        hits = document_windows(toks).join(F.broadcast(windows), "seed")
    else:
        # hits first, without tokens; then each hit of a text meets the tokens of that very text
        windows = written(windows, "windows")
        keys = ["doc_id", "_p", "_q"]
        found = document_windows(toks).select(*keys, "pos", "seed")
        known = windows.groupBy("seed").agg(F.count("*").alias("of"))
        rows = found.join(known, "seed").groupBy("seed").agg(F.count("*").alias("rows"))
        found = written(dealt(found, windows, ["seed"], rows, "pos").drop("seed").distinct(), "hits")
        # equal texts of a doc_id (null ones too) are compared once
        once = toks.where(F.size("doc_toks") >= SPAN).groupBy(*keys).agg(F.any_value("doc_toks").alias("doc_toks"))
        hits = found.alias("f").join(once.alias("t"), F.expr("f.doc_id <=> t.doc_id AND f._p = t._p AND f._q = t._q")).select("f.*", "t.doc_toks")
    best = hits.groupBy("doc_id", "item").agg(F.max(_rank()).alias("rank"))
    best = best.select(
        "doc_id", "item", F.shiftright(F.col("rank"), 5).bitwiseAND(31).alias("matched"), F.col("rank").bitwiseAND(31).alias("compared")
    ).where(F.col("matched") >= F.col("compared") * SHARE)
    named = items.select("item_id", F.xxhash64(tokens(F.col("text"))).alias("item")).distinct()
    out = best.join(named, "item")
    return out.select("doc_id", "item_id", "matched", "compared", (F.col("matched") / F.col("compared")).alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without any confirmed overlap."""
    found = written(overlaps(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(small(found), "doc_id", "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
