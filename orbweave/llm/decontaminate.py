"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask selects positions of a span of tokens and ignores the others, so a hit survives substitutions at ignored positions.
The masks of ``LONG`` together hit every passage of 15 or 20 tokens of which a fifth is substituted, those of ``SHORT`` every item of
5 to 14 tokens with as many substitutions as a fifth allows; items under five tokens allow none and are hashed whole.  Masked
tokens of benchmark items and of documents are hashed and joined.  A hit is verified where it lies: document and item are
aligned on its diagonal and compared token by token in all windows of the item that hold the hit, of 25, 20 and 15 tokens or
the whole of a shorter item.  The overlap counts if at least ``OVERLAP`` of a window is equal; the longest such window, and of
its length the best, stands for the hit.

Tokens are lower-case runs of letters and digits.  Null and empty texts have no tokens and overlap nothing; very long texts are
searched whole.  Items that repeat give a row for each item_id; several hits of a pair give one row, with the best overlap
and, of ties, the first place.  Repeated documents of an id are one row for each item.  An empty table gives an empty
result; extra columns are ignored (``clean`` keeps them).

The document side is one pass: positions, masks, look-up and verification run in one stage without moving a text.  Seeds
and items are broadcast only if the benchmark has at most ``BROADCAST_TOKENS`` tokens; a larger one is joined by shuffled
(hash, document, position) rows, and only texts with a hit are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

LONG = ((0, 1, 2, 3, 4), (0, 2, 3, 5, 6), (0, 1, 4, 5, 7))
#: All but one of five tokens: of 5 to 9 tokens one may differ, and of 10 to 14 two, one of which leaves five tokens at an end alone.
SHORT = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
WINDOWS, OVERLAP = (25, 20, 15), 0.8
BROADCAST_TOKENS = 500_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


#: Masks with the fewest and the most tokens of the items that they serve.
MASKS = [(mask, WINDOWS[-1], None) for mask in LONG] + [(mask, 5, WINDOWS[-1] - 1) for mask in SHORT] + [(tuple(range(n)), n, n) for n in range(1, 5)]


def _hash(number: int, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(number), *(F.get("w", F.col("i") + o) for o in mask))


def hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """One row for each verified hit: id, item, place in the document, overlap."""
    bench = stored(items.select(F.col(item_col).alias("item"), tokens(F.col(item_text_col)).alias("t")).where(F.size("t") > 0))
    size = bench.agg(F.sum(F.size("t")).alias("n")).first()["n"] or 0
    small = size <= BROADCAST_TOKENS
    serves = lambda n, least, most: (n >= least) & (F.lit(True) if most is None else n <= most)
    n = F.size("t")
    used = bench.agg(*(F.coalesce(F.bool_or(serves(n, least, most)), F.lit(False)).alias(f"m{k}") for k, (_, least, most) in enumerate(MASKS))).first()
    wanted = [(k, mask) for k, (mask, _, _) in enumerate(MASKS) if used[k]]
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(None).cast(bench.schema["item"].dataType).alias("item"), *(F.lit(0).alias(c) for c in ("at", "wide", "same"))).where("false")
    least = min(len(mask) for _, mask in wanted)
    placed = bench.select("item", F.col("t").alias("w"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    each = (F.when(serves(F.col("n"), low, high) & (F.col("i") + mask[-1] < F.col("n")), _hash(k, mask)) for k, (mask, low, high) in enumerate(MASKS) if used[k])
    seeds = placed.select("item", F.col("i").alias("at"), F.explode(F.array_compact(F.array(*each))).alias("h")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def looked(frame: DataFrame) -> DataFrame:
        """(.., i, h) of every position and mask; w stays a variable of the stage."""
        at = frame.where(F.size("w") >= least).select(*frame.columns, F.explode(F.sequence(F.lit(0), F.size("w") - least)).alias("i"))
        return at.select(*frame.columns, "i", F.explode(F.array(*(_hash(k, mask) for k, mask in wanted))).alias("h"))

    if small:
        found = looked(rows.select("id", tokens(F.col("text")).alias("w"))).join(F.broadcast(seeds), "h")
        found = found.select("id", "w", "item", "i", "at").join(F.broadcast(bench), "item")
    else:
        keyed = rows.select("id", F.xxhash64("id", "text").alias("rid"), "text")
        narrow = looked(keyed.select("id", "rid", tokens(F.col("text")).alias("w"))).select(F.col("id").alias("own"), F.col("rid").alias("own_rid"), "i", "h").join(seeds, "h").select("own", "own_rid", "item", "i", "at").distinct()
        found = narrow.join(keyed, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_rid") == F.col("rid"))).select("id", tokens(F.col("text")).alias("w"), "item", "i", "at").join(bench, "item")
    at = F.col("at")
    # one bit for each token of the item that a window with the hit can hold, the last one lowest: whether it is equal
    low, high = F.greatest(at - (WINDOWS[0] - 1), F.lit(0)), F.least(at + (WINDOWS[0] - 1), n - 1)
    # only the tokens around the hit go on, since the hits of a document are held together
    start = F.greatest(F.col("i") - (WINDOWS[0] - 1), F.lit(0))
    around = lambda tokens, begin: F.slice(tokens, begin + 1, 2 * WINDOWS[0] - 1)
    found = found.select("id", "item", "i", "at", n.alias("n"), low.alias("low"), high.alias("high"), start.alias("start"), around("t", low).alias("t"), around("w", start).alias("w"))
    low, high = F.col("low"), F.col("high")
    same = lambda k: (k + F.col("i") - at >= 0) & F.get("t", k - low).eqNullSafe(F.get("w", k + F.col("i") - at - F.col("start")))
    bits = F.aggregate(F.sequence(low, high), F.lit(0).cast("long"), lambda all_, k: all_ * 2 + F.when(same(k), 1).otherwise(0).cast("long"))
    found = found.select("id", "item", "at", "n", "high", (F.col("i") - at).alias("shift"), F.explode(F.array(bits)).alias("bits"))  # generated, so that filters don't repeat it

    def best(most: int) -> Column:
        """The best window of a length that holds the hit, if it counts; of equal ones the first."""
        wide = F.least(F.col("n"), F.lit(most))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), wide) - 1
        equal = lambda b: F.bit_count(F.call_function("shiftright", F.col("bits"), F.col("high") - b - wide + 1).bitwiseAND(mask))
        begins = F.sequence(F.greatest(at - wide + 1, F.lit(0)), F.least(at, F.col("n") - wide))
        top = F.array_max(F.transform(begins, lambda b: F.struct(equal(b).alias("same"), (-b).alias("back"))))
        return F.when(top["same"] >= F.ceil(wide * OVERLAP), F.struct((F.col("shift") - top["back"]).alias("at"), wide.alias("wide"), top["same"].alias("same")))

    found = found.where(F.bit_count("bits") >= F.ceil(F.least(F.col("n"), F.lit(WINDOWS[-1])) * OVERLAP))
    return found.select("id", "item", F.explode(F.array_compact(F.array(F.coalesce(*(best(most) for most in WINDOWS))))).alias("b")).select("id", "item", "b.at", "b.wide", "b.same")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_hits, overlap, first_token): each pair of a document and an item that overlap."""
    got = hits(docs, items, id_col, text_col, item_col, item_text_col).distinct()
    share = F.round(F.col("same") / F.col("wide"), 6)
    best = got.groupBy("id", "item").agg(F.count("*").alias("n_hits"), F.max(share).alias("overlap"), F.max_by(F.greatest("at", F.lit(0)), F.struct(share, -F.col("at"))).cast("long").alias("first_token"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_hits", "overlap", "first_token")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no item."""
    bad = hits(docs, items, id_col, text_col, item_col, item_text_col).select(F.col("id").alias(fresh(docs, "__bad"))).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad[bad.columns[0]]), "left_anti")
