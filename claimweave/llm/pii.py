"""Personal data: base patterns, and terms that disclose them (native).

The base finds e-mail addresses, IP addresses, card numbers and phone
numbers. The method then estimates from the whole corpus how strongly
the terms of a document reveal such an entity. For an entity e and a term t,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(N * n_te / (n_t * n_e)) / log(N / n_e)

where N counts documents, n_e and n_t those with the entity and the term,
and n_te those with both, wherever in the document each stands.
At 1 a term occurs with that entity only and so gives it away. Terms over
``REMOVE`` are removed and those over ``GENERALISE`` are replaced by their
shape, at each of their places in every document that has the entity;
terms seen with the entity in fewer than ``SUPPORT`` distinct texts
are no evidence. Base spans always stay and are replaced by their kind.

Everything is built from SQL functions. A text is read for spans, to count
terms and, only where an entity is in ``SUPPORT`` texts, for the terms beside
it; of copies one is shuffled. All counts are aggregated before they are
shuffled. Patterns with possessive quantifiers never backtrack, so long runs
cost linear time.

Defined cases: a null or empty text has no spans. Copies of a text are one
text as evidence, though each is a document. Rows may repeat, and ids may be null: spans depend on the text and
the corpus alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm.tables import persist_cut, table, whole_text

#: Distinct texts that count as evidence, and thresholds of disclosure.
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Letters of a term, at least.
LEAST_LETTERS = 4

#: Kinds in the order in which spans that begin together are listed; the pattern, possessive or anchored where that keeps its matches.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Only runs with twelve digits or more are looked at; what is shorter would be dropped, and so would its ends.
    "card": r"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){11})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to match; looked for first.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        # Every second digit from the right counts double, and 9 less if over 9.
        each = F.split(F.reverse(digits), "")
        double = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
        total = F.aggregate(F.transform(F.filter(each, lambda d: d != ""), double), F.lit(0), lambda a, x: a + x)
        return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)
    return F.lit(True)


def _places(kind: str, text: Column) -> Column:
    """Array of (start, order, kind, end, value) of a kind's valid matches: the pieces between matches give the places."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.length(g))
    order = list(PATTERNS).index(kind)
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,value:string>>")

    def walk(gaps: Column, values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(acc: Column, gap: Column, value: Column) -> Column:
            begin = acc["at"] + gap
            end = begin + F.length(value)
            one = F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("g"), values.alias("v"))
        return F.aggregate(pairs, start, lambda acc, p: step(acc, p["g"], p["v"]), lambda acc: acc["out"])

    hit = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] else text.rlike("[0-9]")
    return F.when(hit, F.filter(walk(lengths, found), lambda s: _valid(kind, s["value"]))).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Array of the base's spans, by start and then by kind."""
    return F.array_sort(F.concat(*[_places(kind, text) for kind in PATTERNS]))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(part: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.transform(F.regexp_extract_all(part, F.lit(r"\p{L}++"), F.lit(0)), F.lower)


def _entities(spans: Column) -> Column:
    """The distinct entities of the spans, however they are written."""

    def one(s: Column) -> Column:
        value = F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], r"[\x20().-]", ""))
        return F.xxhash64(s["kind"], value)

    return F.array_distinct(F.transform(spans, one))


def _terms(text: Column) -> Column:
    """The distinct words of a text that are long enough to be terms."""
    return F.filter(F.array_distinct(_words(text)), lambda w: F.length(w) >= LEAST_LETTERS)


def _term_places(text: Column, scores: Column) -> Column:
    """Array of (start, order, kind, end, value) of each occurrence of the terms in the map ``scores``."""
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,value:string>>")
    pairs = F.arrays_zip(F.split(text, r"\p{L}++", -1).alias("g"), F.regexp_extract_all(text, F.lit(r"\p{L}++"), F.lit(0)).alias("v"))

    def step(acc: Column, p: Column) -> Column:
        # The last gap has no word after it.
        a = acc["at"] + F.length(p["g"])
        b = a + F.coalesce(F.length(p["v"]), F.lit(0))
        term = F.lower(p["v"])
        score = F.element_at(scores, F.coalesce(term, F.lit("")))
        kind = F.when(score >= REMOVE, "removed").otherwise("generalised")
        one = F.struct(a.alias("start"), F.lit(len(PATTERNS)).alias("order"), kind.alias("kind"), b.alias("end"), term.alias("value"))
        return F.struct(b.alias("at"), F.when(score.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, _base (array of spans) and _terms (array of disclosing terms' spans)."""
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_whole"))
    rows = rows.select("_id", "_whole", base_spans(F.col("_whole")).alias("_base"))
    key = F.md5(F.encode("_whole", "UTF-8"))
    found = rows.select("_id", "_base", F.when(F.size("_base") > 0, key).alias("_text"), F.when(F.size("_base") > 0, _entities(F.col("_base"))).alias("_entities"))
    found = persist_cut(found)
    total = found.count()
    # Copies of a text become one row with their number.
    near = persist_cut(found.filter("_text is not null").groupBy("_text").agg(F.count(F.lit(1)).alias("n"), F.first("_entities").alias("_entities")))
    each = near.select("_text", "n", F.explode("_entities").alias("entity"))
    entities = each.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts"))
    entities = persist_cut(entities.filter((F.col("texts") >= SUPPORT) & (F.col("n_e") < total)).drop("texts"))
    # Only texts with an entity that can have evidence are read again.
    chosen = persist_cut(each.join(entities, "entity").groupBy("_text").agg(F.first("n").alias("n"), F.collect_list("entity").alias("_entities")))
    wholes = docs.select(whole_text(text_col).alias("_whole")).filter(F.contains("_whole", F.lit("@")) | F.col("_whole").rlike("[0-9]"))
    wholes = wholes.select(key.alias("_text"), "_whole").groupBy("_text").agg(F.first("_whole").alias("_whole"))
    if chosen.isEmpty():
        wholes = wholes.limit(0)
    read = persist_cut(wholes.join(chosen, "_text"))
    said = read.select("_text", "n", "_entities", F.explode(_terms(F.col("_whole"))).alias("term")).select("_text", "n", "term", F.explode("_entities").alias("entity"))
    together = said.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("n_te")).filter(F.col("contexts") >= SUPPORT)
    together = persist_cut(together)
    texts = docs.select(F.explode(F.array_distinct(_words(whole_text(text_col)))).alias("term"))
    terms = texts.filter(F.length("term") >= LEAST_LETTERS).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    wanted = together.select("term").distinct()
    known = terms.join(wanted, "term")
    ratio = F.log(F.lit(float(max(total, 1))) * F.least("n_te", "n_t", "n_e") / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(float(max(total, 2))) / F.col("n_e"))
    scored = together.join(known, "term").join(entities, "entity").withColumn("disclosure", ratio)
    telling = persist_cut(scored.filter(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure"))
    hit = said.select("_text", "entity", "term").join(telling, ["entity", "term"]).groupBy("_text", "term").agg(F.max("disclosure").alias("disclosure"))
    scores = hit.groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("_scores"))
    of_text = read.join(scores, "_text").select("_text", _term_places(F.col("_whole"), F.col("_scores")).alias("_terms"))
    # Rows without spans need no join; they would all have one key in it.
    rest = found.filter("_text is null").select("_id", "_base", F.lit(None).cast("array<struct<start:int,order:int,kind:string,end:int,value:string>>").alias("_terms"))
    joined = found.filter("_text is not null").join(of_text, "_text", "left").select("_id", "_base", "_terms").unionByName(rest)
    # A term within a base span is covered already.
    free = F.filter(F.coalesce("_terms", F.array().cast("array<struct<start:int,order:int,kind:string,end:int,value:string>>")), lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select(F.col("_id").alias(id_col), "_base", free.alias("_terms"))


def shape(term: Column) -> Column:
    """A term in general form: its kind and length class."""
    return F.concat(F.lit("[TERM-"), F.when(F.length(term) < 8, "SHORT").otherwise("LONG"), F.lit("]"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span (apart, in order) replaced: base spans by their kind, terms by their shape or by nothing."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", shape(s["value"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        skip = s["start"] < acc["at"]  # spans of two kinds may overlap: the first one stands
        put = F.concat(acc["out"], F.array(text.substr(acc["at"] + 1, s["start"] - acc["at"]), new))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(put).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and sanitised text; the texts are shuffled once, by id. Ids must be unique and not null here."""
    spans = find(docs, id_col, text_col).select(id_col, F.array_sort(F.concat("_base", "_terms")).alias("_spans"))
    return docs.select(id_col, whole_text(text_col).alias("_whole")).join(spans, id_col).select(id_col, sanitised(F.col("_whole"), F.col("_spans")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(kind) for kind in PATTERNS],
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("_base", "_terms"))).alias("spans"),
        F.size("_terms").cast("long").alias("n_terms"),
    )
