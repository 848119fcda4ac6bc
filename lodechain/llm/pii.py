"""Operator 3: PII, with information-theoretic sanitisation, in DataFrame functions only.

Base patterns find protected entities (e-mail and IP addresses, card and phone numbers). Words of a document
that holds one may give the entity away even when the mention itself is masked. How strongly word t reveals entity c is
estimated from document co-occurrence over the whole corpus: PMI(c; t) / IC(c), that is
log(n_ct * N / (n_c * (n_t + 1))) / log(N / n_c), which is near 1 if t is found with c only and in proportion less the
more t is found elsewhere. Every count is scored, however small; the one more document is add-one smoothing, which
holds back single meetings in a corpus too small to tell. Words at or above ``generalise_at`` are generalised wherever they stand in the documents that hold
the entity; at or above ``remove_at`` they are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodechain.llm.common import fresh, text_key
from lodechain.llm.spans import Kind, listed, number, running, with_spans
from lodechain.session import cut


def _octets(v: Column) -> Column:
    bare = F.transform(F.split(v, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.forall(bare, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))


def _luhn(v: Column) -> Column:
    digits = F.reverse(F.translate(v, " -", ""))
    n = F.length(digits)
    value = lambda i: F.ascii(F.substring(digits, i, 1)) - 48
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i)))
    return F.when((n >= 14) & (n <= 19), total % 10 == 0).otherwise(False)


BASE = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _octets),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(F.translate(v, "+ ().-", "")).between(10, 15)),
]
#: A word: letters and digits, a letter among them, joined by single hyphens or apostrophes; 3 characters at least.
WORD = r"(?<![\p{L}\p{M}\p{N}])(?=[\p{N}\p{M}'\u2019-]*+\p{L})(?=[\p{L}\p{M}\p{N}'\u2019-]{3})[\p{L}\p{M}\p{N}]++(?:['\u2019-][\p{L}\p{M}\p{N}]++)*+"
#: Addresses come first, so that their parts are no words.
TOKEN = f"{BASE[0].pattern}|{WORD}"


def base_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with the base spans of each whole text (null: none)."""
    return with_spans(docs, text, BASE, out)


def _words(held: DataFrame) -> DataFrame:
    """(k, key, term, start, end) of all words of the texts t. Matches and lengths are written before they are summed,
    since the sums read them many times."""
    t = F.col("t")
    found = held.select("k", "key", F.split(t, TOKEN, -1).alias("p"), F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)).alias("v"))
    found = cut(found.select("k", "key", "v", F.zip_with(F.slice("p", 1, F.size("v")), "v", lambda p, v: F.length(p) + F.length(v)).alias("n")))
    each = found.withColumn("e", running(F.col("n"))).select("k", "key", F.explode(F.arrays_zip("v", "e")).alias("w"))
    return each.where(~F.col("w.v").contains("@")).select("k", "key", F.lower("w.v").alias("term"), (F.col("w.e") - F.length("w.v")).alias("start"), F.col("w.e").alias("end"))


def _terms(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower), lambda w: ~w.contains("@")))


def holders(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, k, key, t, entities): the documents that hold an entity, repeated rows once."""
    rows = base_spans(docs.select(F.xxhash64(doc_id).alias("k"), F.col(text).alias("t")), "t")
    # a column that is not deterministic, and that is kept, keeps the optimizer from repeating the pattern searches in a
    # pushed-down filter
    rows = rows.withColumn("row", F.monotonically_increasing_id()).where(F.size("spans") > 0)
    named = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(s["value"])))
    return rows.select("row", "k", text_key(F.col("t")).alias("key"), "t", F.array_distinct(named).alias("entities")).dropDuplicates(["k", "key"])


def disclosures(docs: DataFrame, held: DataFrame, least: float, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entity, term, disclosure) of the pairs at or above ``least``, counts over all documents; and the pairs by
    document (k, key, entity, term) among which they are.

    A pair meets in n_c documents at most, so its disclosure is at most log(N / (n_t + 1)) / log(N / n_c): a term too
    frequent for an entity is left out before pairs are made, and one too frequent for all entities before the join.
    """
    total = float(docs.count())
    each = held.select("k", "key", F.explode("entities").alias("entity"))
    n_c = cut(each.groupBy("entity").agg(F.count("*").alias("n_c")).where(F.col("n_c") < total))
    bound = lambda n: least * (1 - 1e-9) * F.log(total / n)
    lowest = n_c.agg(F.min(bound(F.col("n_c")))).first()[0]
    room = F.log(total / (F.col("n_t") + 1))
    n_t = docs.select(F.explode(_terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n_t = cut(n_t.where(room >= (float("inf") if lowest is None else lowest)))
    ready = each.join(n_c, "entity").groupBy("k", "key").agg(F.collect_list(F.struct("entity", "n_c")).alias("es"), F.min(bound(F.col("n_c"))).alias("low"))
    in_docs = held.select("k", "key", F.explode(_terms(F.col("t"))).alias("term")).join(n_t, "term")
    able = in_docs.join(ready, ["k", "key"]).where(room >= F.col("low"))
    pairs = able.select("k", "key", "term", "n_t", F.explode("es").alias("e")).where(room >= bound(F.col("e.n_c")))
    pairs = cut(pairs.select("k", "key", "term", "n_t", "e.entity", "e.n_c"))
    n_ct = pairs.groupBy("entity", "term", "n_c", "n_t").agg(F.count("*").alias("n_ct"))
    ratio = F.log(F.col("n_ct") * total / (F.col("n_c") * (F.greatest("n_t", "n_ct") + 1))) / F.log(total / F.col("n_c"))
    scored = n_ct.withColumn("disclosure", ratio).where(F.col("disclosure") >= least)
    return cut(scored.select("entity", "term", "disclosure")), pairs.select("k", "key", "entity", "term")


def term_spans(docs: DataFrame, generalise_at: float = 0.8, remove_at: float = 0.95, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, key, terms): for documents with disclosing words, the spans of kind ``term``, with the action taken."""
    held = cut(holders(docs, doc_id, text))
    found, pairs = disclosures(docs, held, generalise_at, text)
    worst = cut(pairs.join(found, ["entity", "term"]).groupBy("k", "key", "term").agg(F.max("disclosure").alias("d")))
    some = held.join(worst.select("k", "key").distinct(), ["k", "key"], "left_semi")
    worst = _words(some).join(worst, ["k", "key", "term"])
    span = F.struct("start", F.lit(len(BASE)).alias("kind_order"), "end", F.lit("term").alias("kind"), F.when(F.col("d") >= remove_at, "").otherwise("[term]").alias("value"))
    return worst.groupBy("k", "key").agg(F.array_sort(F.collect_list(span)).alias("terms"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: str = "spans", terms: str = "terms", **thresholds) -> DataFrame:
    """``docs`` with ``spans`` (base) and ``terms`` (added by the method), arrays of (start, kind_order, end, kind,
    value). Positions count code points, ends are exclusive. Null and empty texts have none; repeated rows get the
    same spans each; a null id is an id like any other; columns named like the outputs are replaced, all others stay;
    an empty table gives an empty result. Texts are read whole; a text with n matches costs about n * sqrt(n) steps."""
    found = cut(term_spans(docs, doc_id=doc_id, text=text, **thresholds))
    k, key = fresh(docs, "k", "key")
    rows = base_spans(docs.drop(terms), text, spans).withColumns({k: F.xxhash64(doc_id), key: text_key(F.col(text))})
    joined = rows.join(found.withColumnsRenamed({"k": k, "key": key, "terms": terms}), [k, key], "left").drop(k, key)
    return joined.withColumn(terms, F.coalesce(terms, F.array().cast(found.schema["terms"].dataType)))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """``docs`` with mentions replaced by their kind in brackets, disclosing words generalised or removed. Spans that
    overlap an earlier one are covered by it up to the later end. Texts without spans, null and empty ones stay as they
    are, as do all other columns, whatever their names; an empty table gives an empty result."""
    base, terms, whole = fresh(docs, "spans", "terms", "all")
    found = find(docs, doc_id, text, base, terms, **thresholds)
    every = F.array_sort(F.concat(F.transform(base, lambda s: s.withField("value", F.concat(F.lit("["), s["kind"], F.lit("]")))), F.col(terms)))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.try_element_at(acc, F.lit(-1)).withField("end", F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]))))).otherwise(F.concat(acc, F.array(s)))
    found = found.withColumn(whole, every)
    kind = found.schema[whole].dataType
    found = found.withColumn(whole, F.aggregate(whole, F.array().cast(kind), step))
    t = F.col(text)
    end_before = lambda i: F.when(i > 0, F.col(whole)[F.greatest(i - 1, F.lit(0))]["end"]).otherwise(0)
    parts = F.transform(whole, lambda s, i: F.concat(t.substr(end_before(i) + 1, s["start"] - end_before(i)), s["value"]))
    rest = t.substr(F.try_element_at(whole, F.lit(-1))["end"] + 1, F.length(t))
    made = F.when(F.size(whole) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(t)
    return found.withColumn(text, made).drop(whole, base, terms)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans."""
    spans = F.col("spans")
    every = F.array_sort(F.concat(spans, F.col("terms")))
    return found.select(doc_id, *[number(spans, k.name).alias(f"n_{k.name}") for k in BASE], F.sha2(listed(spans), 256).alias("base_sha256"), listed(every).alias("spans"))
