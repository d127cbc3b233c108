r"""Information-theoretic sanitisation of personal data, in DataFrame functions alone.

Patterns find the protected entities.  Words near an entity may give it away as
well: over the corpus, the pointwise mutual information between a word and an
entity is compared with the entity's own information content, and a word that
reveals more than a set share of it is a span too.  The sanitised text has
generalised marks for entities and lacks the revealing words.

Java's matcher recurses on repeated groups, which very long texts overflow.
The patterns here are character classes only: a first pass marks the inner
separators (dots of a domain, single blanks in a number) with a code point
that the text doesn't have, so spans keep their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, durable, table

KINDS = ("email", "ip", "card", "phone")
JOIN, OTHER = "", ""
LOCAL = f"A-Za-z0-9._%+{JOIN}-"
#: What is searched: the marked separators, and the pattern.  A match starts where the last one ended or a run begins.
EMAIL_DOT, EMAIL = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]+{JOIN}[A-Za-z0-9{JOIN}-]+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_GAP, CARD = r"(?<=[0-9])[ -](?=[0-9])", f"[0-9][0-9{JOIN}]+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"\p{L}+"
#: Code points on either side of an entity in which words may give it away.
REACH = 64
#: Documents in which a word must stand with an entity, and the share of its information that it may reveal.
SUPPORT, DISCLOSURE = 3, 0.8
SPAN = "array<struct<s:bigint,e:bigint,v:string>>"
NONE = f"cast(array() as {SPAN})"
#: Spans that are gathered at a time.
HELD = 256


def located(text: Column, pattern: str, keep) -> Column:
    """Spans (s, e, v) of the pattern's matches for which keep(v) holds, in code points.

    The pieces between matches and the matches themselves give the places.
    Appending copies an array, so spans are gathered a few hundred at a time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), found, lambda p, v: F.struct(F.length(p).cast("long").alias("gap"), v.alias("v")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(NONE).alias("held"), F.expr(f"cast(array() as array<{SPAN}>)").alias("full"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.coalesce(F.length(x["v"]), F.lit(0))
        span = F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"))
        state = lambda held, full: F.struct(e.alias("at"), held.alias("held"), full.alias("full"))
        more = F.when(F.size(acc["held"]) < HELD, state(F.array_append(acc["held"], span), acc["full"])).otherwise(state(F.array(span), F.array_append(acc["full"], acc["held"])))
        return F.when(x["v"].isNotNull() & keep(x["v"]), more).otherwise(state(acc["held"], acc["full"]))

    spans = F.aggregate(both, start, step, lambda acc: F.flatten(F.array_append(acc["full"], acc["held"])))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(NONE))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def small_parts(v: Column) -> Column:
    """Every part at most 255, whatever leading zeros it has."""

    def small(x: Column) -> Column:
        x = F.regexp_replace(x, "^0+", "")
        return (F.length(x) <= 3) & (F.coalesce(F.substring(x, 1, 3).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(v, "\\."), small)


def luhn(v: Column) -> Column:
    d = F.reverse(digits(v))
    doubled = lambda i: F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1)) * F.substring(d, i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda acc, i: acc + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return F.length(d).between(16, 19) & (total % 10 == 0)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base spans of each kind of every row; null text is empty."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    clear = F.when(F.contains("text", F.lit(JOIN)), F.translate("text", JOIN, OTHER)).otherwise(F.col("text"))
    t = t.withColumn("clear", clear)
    digit = F.col("clear").rlike("[0-9]")
    t = t.select(
        "doc_id",
        "text",
        "clear",
        F.when(F.contains("clear", F.lit("@")), F.regexp_replace("clear", EMAIL_DOT, JOIN)).otherwise(F.lit("")).alias("for_email"),
        F.when(digit, F.regexp_replace("clear", CARD_GAP, JOIN)).otherwise(F.lit("")).alias("for_card"),
        F.when(digit, F.col("clear")).otherwise(F.lit("")).alias("for_ip"),
        F.when(F.contains("clear", F.lit("+")), F.col("clear")).otherwise(F.lit("")).alias("for_phone"),
    )
    return t.select(
        "doc_id",
        "text",
        located(F.col("for_email"), EMAIL, lambda v: F.lit(True)).alias("email"),
        located(F.col("for_ip"), IP, small_parts).alias("ip"),
        located(F.col("for_card"), CARD, luhn).alias("card"),
        located(F.col("for_phone"), PHONE, lambda v: F.length(digits(v)).between(8, 15)).alias("phone"),
    )


def surroundings(rows: DataFrame) -> DataFrame:
    """(doc_id, entity, word, s, e) for each word that lies whole within REACH of an entity; rows have doc_id, text and spans.

    One code point more is read, so a word that goes on beyond is seen to touch the edge.
    """
    each = rows.select("doc_id", "text", F.explode(F.concat(*KINDS)).alias("x"))
    low = F.greatest(F.col("x.s") - REACH - 1, F.lit(0))
    each = each.select(
        "doc_id",
        F.lower(F.translate("x.v", JOIN, ".")).alias("entity"),
        F.explode(
            F.array(
                F.struct(low.alias("at"), F.substring("text", (low + 1).cast("int"), (F.col("x.s") - low).cast("int")).alias("around"), F.least(low, F.lit(1)).alias("least"), (F.col("x.s") - low).alias("most")),
                F.struct(F.col("x.e").alias("at"), F.substring("text", (F.col("x.e") + 1).cast("int"), F.lit(REACH + 1)).alias("around"), F.lit(0).cast("long").alias("least"), F.lit(REACH).cast("long").alias("most")),
            )
        ).alias("w"),
    ).select("doc_id", "entity", "w.*")
    words = each.select("doc_id", "entity", "at", "least", "most", F.explode(located(F.col("around"), WORD, lambda v: F.lit(True))).alias("x")).where("x.s >= least and x.e <= most")
    return words.select("doc_id", "entity", F.lower("x.v").alias("word"), (F.col("at") + F.col("x.s")).alias("s"), (F.col("at") + F.col("x.e")).alias("e"))


def revealing(near: DataFrame, docs: DataFrame, n_entity: DataFrame, n_docs: int) -> DataFrame:
    """(entity, word) where the word reveals more of the entity than it may.

    PMI = log(n_both * N / (n_entity * n_word)) against the entity's information
    log(N / n_entity).  Words are counted over the whole corpus; the
    candidates are those that stand with an entity in SUPPORT documents, and
    they meet the counts, not the words.  n_both and n_entity count
    doc_ids, copies included.
    """
    once = near.groupBy("entity", "word", "doc_id").agg(F.lit(1).alias("one"))
    both = durable(once.groupBy("entity", "word").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= SUPPORT))
    words = durable(both.select("word").distinct())
    few = words.limit(BROADCAST_IDS + 1).count()
    if not few:
        return both.select("entity", "word")
    said = docs.select(F.explode(F.array_distinct(F.transform(F.array_distinct(F.split("text", r"[^\p{L}]+")), F.lower))).alias("word"))
    n_word = said.groupBy("word").agg(F.count("*").alias("n_word")).join(F.broadcast(words) if few <= BROADCAST_IDS else words, "word")  # not a semi-join, which would be pushed below the counts
    told = both.join(n_entity, "entity").join(n_word, "word")
    pmi = F.log(F.col("n_both") * n_docs / (F.col("n_entity") * F.col("n_word")))
    return told.where(pmi >= DISCLOSURE * F.log(F.lit(float(n_docs)) / F.col("n_entity"))).where(F.col("n_entity") < n_docs).select("entity", "word")


def sanitise(docs: DataFrame) -> DataFrame:
    """Counts, base digest, spans, and the sanitised text of every row.

    Spans are kind:start:end, by kind (email, ip, card, phone, term), then
    start; terms are the revealing words.  Overlapping spans are replaced
    once, by the mark of the first.  Null text is empty; a row with a null
    doc_id gets no terms; rows that repeat a doc_id share their terms.
    """
    rows = durable(entities(docs).select("doc_id", *KINDS, F.when(F.size(F.concat(*KINDS)) > 0, F.col("text")).alias("text")))
    own = rows.where("text is not null and doc_id is not null")
    near = durable(surroundings(own))
    n_entity = own.select("doc_id", F.explode(F.concat(*KINDS)).alias("x")).select("doc_id", F.lower(F.translate("x.v", JOIN, ".")).alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    flagged = near.join(revealing(near, docs, n_entity, max(1, rows.count())), ["entity", "word"], "left_semi")
    terms = flagged.groupBy(F.col("doc_id").alias("of")).agg(F.array_sort(F.collect_set(F.struct("s", "e", F.col("word").alias("v")))).alias("term"))
    told = rows.join(terms, F.col("doc_id") == F.col("of"), "left").withColumn("term", F.coalesce("term", F.expr(NONE)))
    said = lambda kind: F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))

    def marked(kind: str, mark: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(mark).alias("m")))

    marks = F.array_sort(F.concat(*(marked(k, f"[{k.upper()}]") for k in KINDS), marked("term", "")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda acc, x: F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), F.concat(acc["out"], piece(acc["at"], x["s"]), x["m"]).alias("out")))
    clean = F.when(F.size("marks") > 0, F.aggregate("marks", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))))
    return told.withColumn("marks", marks).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.concat(*(said(k) for k in KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*(said(k) for k in (*KINDS, "term"))), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
        clean.alias("sanitised"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents")).drop("sanitised")
