"""Personal data by patterns and information-theoretic sanitisation, in DataFrame functions only.

Base entities are e-mail addresses, IPv4 addresses, payment cards and phone numbers; secrets (long strings of letters and
digits whose characters carry at least ``SECRET_BITS``) are protected, too.  The method then asks what the words around an
entity tell about it.  Protected are each kind of entity and each value that stands in ``SUPPORT`` different texts or more.
Over the whole corpus, documents are counted in which a term stands within ``NEAR`` code points of the entity, in which the
term occurs at all, and in which the entity occurs.  The pointwise mutual information of term and entity, as a share of the
entity's own information content, is the share of the entity that the term discloses.  Terms whose share is at least
``GENERALISE`` are generalised, from ``REMOVE`` on removed, wherever they stand near that entity.

Chance is kept out by a threshold that the corpus sets: the information of a term times the number of different texts that
show it near the entity must exceed the bits that name one of all candidate pairs of term and entity, and ``DOUBT`` bits more.

Null texts are empty.  Exact copies of a text are one text for the support, and count as documents.  Rows are told apart by id and
a hash of the text; a repeated row gets its own result.  Secrets and terms inside a base entity are left to it.  An empty table
gives an empty result, very long texts are read whole, and extra columns are ignored (``sanitise`` keeps them).

Patterns are possessive where the next character cannot be part of the repeated one, and tried only where a run begins, so
that very long texts are matched in linear time and without deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hot_keys, salted_join, stored

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?:\G|(?<![A-Za-z0-9_]))[A-Za-z0-9_]{20,}+"
#: Characters of a secret, what they must carry, and how often letters and digits must change in it.
SECRET_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"
SECRET_BITS, SECRET_TURNS = 64.0, 3
NEAR, SUPPORT, GENERALISE, REMOVE, DOUBT = 80, 2, 0.6, 0.9, 7.0
#: At most so many terms, or pairs of term and entity, are broadcast.
BROADCAST_TERMS = 100_000
MARK = "\u0001"
SPAN = "array<struct<kind:string,start:int,end:int>>"


def _pieces(text: Column, pattern: str) -> Column:
    """Struct (kind, start, end, value) of each match, from the text split at marks around the matches."""
    # a mark in the text becomes another character that no pattern takes, so no position moves
    parts = F.split(F.regexp_replace(F.translate(text, MARK, "\u0002"), f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(acc["hit"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), x.alias("value"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(x, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("bigint"), F.lit(256)) <= 255))
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def matches(text: Column) -> Column:
    """array<struct<kind,start,end,value>> of the base entities, by kind, then start."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    cheap = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "phone": F.contains(text, F.lit("+"))}

    def of(kind: str, pattern: str) -> Column:
        good = F.filter(_pieces(text, pattern), lambda m: _valid(kind, m["value"]))
        named = F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        return F.when(cheap[kind], named).otherwise(none)

    return F.concat(*(of(kind, pattern) for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True)))


def _information(x: Column) -> Column:
    """Bits of a string under the distribution of its own characters."""
    n = F.length(x)

    def of(acc: Column, c: Column) -> Column:
        k = n - F.length(F.replace(x, c, F.lit("")))
        return acc + F.when(k > 0, k * F.log2(n / k)).otherwise(0.0)

    return F.aggregate(F.array(*map(F.lit, SECRET_CHARS)), F.lit(0.0), of)


def secrets(text: Column) -> Column:
    """array<struct<kind,start,end,value>> of strings that carry much information."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    turns = lambda x: F.regexp_count(x, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))
    good = F.filter(_pieces(text, SECRET), lambda m: (turns(m["value"]) >= SECRET_TURNS) & (_information(m["value"]) >= SECRET_BITS))
    named = F.transform(good, lambda m: F.struct(F.lit("secret").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.when(text.rlike("[A-Za-z0-9_]{20}"), named).otherwise(none)


def _near(text: Column, lo: Column, hi: Column) -> Column:
    """Whole lower-case words of text[lo:hi) as struct (term, start, end)."""
    cut_text = F.translate(F.substring(text, lo + 1, hi - lo), MARK, "\u0002")
    words = F.split(F.regexp_replace(cut_text, r"(\p{L}++)", f"{MARK}$1{MARK}"), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast("array<struct<term:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x)
        # a word cut off by the window's edge is not whole
        whole = acc["hit"] & ((acc["at"] > 0) | (lo == 0)) & ((end < hi - lo) | (hi >= F.length(text)))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(whole, F.concat(acc["out"], F.array(F.struct(F.lower(x).alias("term"), (acc["at"] + lo).alias("start"), (end + lo).alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def terms(text: Column) -> Column:
    """The different words of a text."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), ""))


def _outside(spans: Column, base: Column) -> Column:
    return F.filter(spans, lambda x: ~F.exists(base, lambda m: (x["start"] < m["end"]) & (m["start"] < x["end"])))


def telling(entity: DataFrame, docs: DataFrame, text_col: str, n_docs: int) -> DataFrame:
    """(entity, term, kind): the terms that disclose an entity.

    entity: (rid, tid, entity, words), one row for each place of an entity.
    """
    n_entity = entity.select("entity", "tid", "rid").distinct().groupBy("entity", "tid").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("in_texts")).where(F.col("in_texts") >= SUPPORT)
    near = entity.select("entity", "tid", "rid", F.explode("words.term").alias("term")).distinct()
    pairs = near.groupBy("entity", "term", "tid").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    pairs = stored(pairs)  # a kind of entity is a hot key
    pairs = stored(salted_join(pairs, n_entity, ["entity"], hot_keys(pairs.groupBy("entity").agg(F.count("*").alias("n")), ["entity"]), ["term"]))
    candidates = pairs.count()
    if not candidates:
        return pairs.select("entity", "term", F.lit("").alias("kind"))
    wanted = stored(pairs.select("term").distinct())
    used = docs.select(F.explode(terms(F.col(text_col))).alias("term"))
    number = F.count("*").alias("n_t")
    if wanted.count() <= BROADCAST_TERMS:
        counts = used.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(number)
    else:  # summed before the join, so that a frequent term is no hot key
        counts = used.groupBy("term").agg(number).join(wanted, "term", "left_semi")
    bits = F.log2(F.col("n_te") * F.lit(float(n_docs)) / (F.col("n_t") * F.col("n_e")))
    share = bits / F.log2(F.greatest(F.lit(2.0), F.lit(float(n_docs)) / F.col("n_e")))
    sure = F.col("texts") * bits >= F.log2(F.lit(float(candidates))) + DOUBT
    hot = hot_keys(pairs.groupBy("term").agg(F.count("*").alias("n")), ["term"])
    return salted_join(pairs, counts, ["term"], hot, ["entity"]).where(sure & (share >= GENERALISE)).select("entity", "term", F.when(share >= REMOVE, "removed").otherwise("generalised").alias("kind"))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rid, base, extra): base entities and the method's spans (secrets and telling terms) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rid"), F.xxhash64(text).alias("tid"), text.alias("text"), matches(F.col(text_col)).alias("base"), secrets(text).alias("secret"))
    rows = rows.withColumn("secret", _outside(F.col("secret"), F.col("base")))
    sides = lambda m: F.concat(_near(F.col("text"), F.greatest(m["start"] - NEAR, F.lit(0)), m["start"]), _near(F.col("text"), m["end"], F.least(m["end"] + NEAR, F.length("text"))))
    around = F.transform(F.concat("base", "secret"), lambda m: F.struct(m["kind"].alias("kind"), m["value"].alias("value"), sides(m).alias("words")))
    plain = lambda c: F.transform(c, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    rows = stored(rows.select("id", "rid", "tid", plain("base").alias("base"), plain("secret").alias("secret"), around.alias("around")))
    place = rows.where(F.size("around") > 0).select("id", "rid", "tid", F.explode("around").alias("e"))
    names = F.array(F.col("e.kind"), F.concat_ws(":", "e.kind", F.lower("e.value")))
    entity = place.select("id", "rid", "tid", F.explode(names).alias("entity"), "e.words")
    tell = stored(telling(entity, docs, text_col, rows.count()))
    n_tell = tell.count()
    spans = F.lit(None).cast("array<struct<start:int,end:int,kind:string>>")
    out = rows.withColumn("near", spans)
    if n_tell:
        seen = entity.select("id", "rid", "entity", F.explode("words").alias("x")).select("id", "rid", "entity", "x.*")
        if n_tell <= BROADCAST_TERMS:
            near = seen.join(F.broadcast(tell), ["entity", "term"])
        else:
            hot = hot_keys(seen.groupBy("entity", "term").agg(F.count("*").alias("n")), ["entity", "term"])
            near = salted_join(seen, tell, ["entity", "term"], hot, ["rid", "start"])
        near = near.groupBy("id", "rid").agg(F.collect_set(F.struct("start", "end", "kind")).alias("near"))
        near = near.select(F.col("id").alias("__id"), F.col("rid").alias("__rid"), "near")
        out = rows.join(near, rows["id"].eqNullSafe(near["__id"]) & (rows["rid"] == near["__rid"]), "left")
    free = _outside(_outside(F.col("near"), F.col("base")), F.col("secret"))
    # a span that two entities judge differently is removed
    one = F.filter(free, lambda x: (x["kind"] == "removed") | ~F.exists(F.col("near"), lambda y: (y["start"] == x["start"]) & (y["kind"] == "removed")))
    extra = F.array_sort(F.concat("secret", F.coalesce(plain(one), F.array().cast(SPAN))), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return out.select(F.col("id").alias(id_col), "rid", "base", extra.alias("extra"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: numbers of base entities, the digest of their spans, all spans, and numbers of the method's spans."""
    listed = lambda c: F.concat_ws(",", F.transform(c, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))))
    got = found(docs, id_col, text_col)
    number = lambda k, c: F.size(F.filter(c, lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select(id_col, *(number(k, "base") for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"), *(number(k, "extra") for k in ("secret", "generalised", "removed")))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each base entity and secret replaced by its kind in brackets, generalised terms by [TERM], and removed terms gone."""
    got = found(docs, id_col, text_col).where((F.size("base") > 0) | (F.size("extra") > 0))
    own, rid_, spans = (fresh(docs, x) for x in ("__id", "__rid", "__spans"))
    got = got.select(F.col(id_col).alias(own), F.col("rid").alias(rid_), F.array_sort(F.transform(F.concat("base", "extra"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind")))).alias(spans)).dropDuplicates([own, rid_])
    rid = F.xxhash64(id_col, text_col)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        name = F.when(m["kind"] == "generalised", "[TERM]").when(m["kind"] == "removed", "").otherwise(F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]")))
        fresh = F.struct(m["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), name).alias("out"))
        # one that begins inside the last one only lengthens it
        return F.when(m["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], m["end"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    joined = docs.join(got, F.col(id_col).eqNullSafe(F.col(own)) & (rid == F.col(rid_)), "left")
    return joined.select(*(F.when(F.col(spans).isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(c) for c in docs.columns))
