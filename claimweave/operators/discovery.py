"""Hypotheses from asserted claims: shared dependencies, scores, evidence and gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions import score
from claimweave.operators.graph import ends_of
from claimweave.operators.ingest import arrival_ranks
from claimweave.session import cut

# A predicate that contains one of these says that its subject depends on its object.
DEPENDENCY = ("suppl", "customer", "audit", "agent", "board", "backs", "partner", "invest", "contract", "sourc", "depend", "procur", "relies", "buys")
#: Claims of each side that a hypothesis keeps, and hypotheses of a run.
SIDE_CLAIMS, MOST = 30, 50
#: Reliability under which lineages count as one, and from which one is established.
LOW, ESTABLISHED, REQUIRED = 0.4, 0.5, 2
TOP, LEAST_SCORE = 5, 0.05
#: Claims that a hypothesis's subgraph shows: of its evidence, and further ones of each subject.
EVIDENCE_SHOWN, SUBJECT_SHOWN = 30, 15
#: Companies of a run, and pairs that a task forms, where all pairs are wanted.
RUN, TASK_PAIRS = 1000, 1_000_000


def dependencies(asserted: DataFrame, entity: DataFrame) -> DataFrame:
    """Claims by which a company points at something that it depends on."""
    companies = entity.filter("kind = 'company'").select(F.col("entity_id").alias("subject_entity"))
    some = asserted.filter("object_entity is not null and subject_entity != object_entity").filter(score.contains_any(F.lower("predicate_raw"), DEPENDENCY))
    return some.join(companies, "subject_entity", "left_semi")


def shared_pairs(dependency: DataFrame) -> DataFrame:
    """(a, b, via): companies that point at the same thing, formed in as many tasks as their number asks for.

    The pairs of a thing grow with the square of its companies, so these are
    cut into runs of ``RUN``, and two runs meet in a cell of their own.
    """
    sides = cut(dependency.select("subject_entity", F.col("object_entity").alias("via")).distinct())
    counted = sides.groupBy("via").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    pairs = counted.agg(F.sum(F.col("_n").cast("double") * (F.col("_n") - 1) / 2)).first()[0] or 0
    tasks, cell = 1 + int(pairs // TASK_PAIRS), ["via", "_x", "_y"]
    runs = sides.join(counted, "via").withColumn("_runs", F.ceil(F.col("_n") / RUN))
    dealt = runs.select("via", "subject_entity", F.pmod(F.xxhash64("subject_entity"), "_runs").alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_runs") - 1)).alias("_other"))
    a = dealt.select("via", F.col("subject_entity").alias("a"), F.col("_own").alias("_x"), F.col("_other").alias("_y")).repartition(tasks, *cell)
    b = dealt.select("via", F.col("subject_entity").alias("b"), F.col("_other").alias("_x"), F.col("_own").alias("_y")).repartition(tasks, *cell)
    # Dealt again by their companies, so that what follows for each pair needs no more of a task than this.
    return a.join(b, cell).filter("a < b").select("a", "b", "via").repartition(tasks, "a", "b")


def best_linked(dependency: DataFrame, most: int) -> DataFrame:
    """(a, b, score): the ``most`` pairs of companies that share most; what n companies point at adds 1 / ln(1 + n).

    Of equal scores, rounded to six places, the first in order of a and b.
    Companies are numbered in their order. Of all pairs only the numbers of
    b are dealt, as lists, to the task of a; it sums one a's pairs at a time
    and keeps the best ``most``, so pairs are dealt once, four bytes each.
    """
    sides = cut(dependency.select("subject_entity", F.col("object_entity").alias("via")).distinct())
    subjects = sides.select(F.col("subject_entity").alias("position")).distinct().withColumn("event_id", F.col("position"))
    numbers = cut(arrival_ranks(subjects).select(F.col("event_id").alias("subject_entity"), F.col("position").cast("int").alias("_at")))
    counted = sides.groupBy("via").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    pairs = counted.agg(F.sum(F.col("_n").cast("double") * (F.col("_n") - 1) / 2)).first()[0] or 0
    placed = cut(sides.join(counted, "via").join(numbers, "subject_entity").select("via", "_n", "_at"))
    runs = placed.groupBy("via", F.pmod(F.xxhash64("_at"), F.ceil(F.col("_n") / RUN)).alias("_run")).agg(F.sort_array(F.collect_list("_at")).alias("_all")).drop("_run")
    after = F.filter("_all", lambda b: b > F.col("_at")).alias("_after")
    lists = placed.join(runs, "via").select("_at", (1.0 / F.log1p("_n")).alias("_adds"), after).filter(F.size("_after") > 0)
    dealt = lists.repartition(1 + int(pairs // TASK_PAIRS), "_at").sortWithinPartitions("_at")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, [("a", np.int32), ("b", np.int32), ("score", np.float64)])
        here, size, ends, adds = None, 0, [], []

        places = lambda x: np.floor(x * 1e6 + 0.5)

        def summed() -> None:
            """The ends that are gathered become one each."""
            b, place = np.unique(np.concatenate(ends), return_inverse=True)
            ends[:], adds[:] = [b], [np.bincount(place, np.concatenate(adds))]

        def done() -> None:
            nonlocal kept
            summed()
            # Companies come in order, so of equal scores the ones kept so far are first.
            better = places(adds[0]) > (places(kept["score"]).min() if len(kept) == most else -1)
            if better.any():
                some = np.zeros(better.sum(), kept.dtype)
                some["a"], some["b"], some["score"] = here, ends[0][better], adds[0][better]
                every = np.concatenate([kept, some])
                kept = every[np.lexsort((every["b"], every["a"], -places(every["score"])))[:most]]

        for batch in batches:
            afters = batch.column(2)
            for at, add, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), range(batch.num_rows), strict=True):
                if at != here:
                    if ends:
                        done()
                    here, size, ends, adds = at, 0, [], []
                some = afters[i].values.to_numpy()
                ends.append(some)
                adds.append(np.full(len(some), add))
                size += len(some)
                if size > TASK_PAIRS:
                    summed()
                    size = 0
        if ends:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(kept[c]) for c in ("a", "b", "score")], ["_a", "_b", "score"])

    found = dealt.select("_at", "_adds", "_after").mapInArrow(best, "_a int, _b int, score double")
    found = cut(found.withColumn("_round", F.round("score", 6)).orderBy(F.col("_round").desc(), "_a", "_b").limit(most))
    for side in ("a", "b"):
        found = found.join(numbers.select(F.col("_at").alias(f"_{side}"), F.col("subject_entity").alias(side)), f"_{side}")
    return found.select("a", "b", F.col("_round").alias("score"))


def without_edge(pairs: DataFrame, edge: DataFrame) -> DataFrame:
    """Pairs with no edge either way: edges are put in one order, so that one equi anti-join does."""
    known = edge.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def first_pairs(dependency: DataFrame, edge: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of all (a, b, via) without an edge, in that order.

    Pairs grow with the square of what points at a thing, so they are formed
    for the first companies in order alone. If these have too few open pairs,
    four times as many companies are taken, in the end all of them, so
    nothing is cut off: every other pair comes after those.
    """
    sides = cut(dependency.select("subject_entity", F.col("object_entity").alias("via")).distinct())
    subjects = sides.select("subject_entity").distinct()
    takes = most
    while True:
        firsts = subjects.orderBy("subject_entity").limit(takes)
        upto, taken = firsts.agg(F.max("subject_entity"), F.count(F.lit(1))).first()
        a = sides.filter(F.col("subject_entity") <= F.lit(upto)).select(F.col("subject_entity").alias("a"), "via")
        pairs = a.join(sides.withColumnRenamed("subject_entity", "b"), "via").filter("a < b").select("a", "b", "via")
        # An edge matters if its lesser end is among these companies.
        near = edge.select("src", "dst").filter(F.least("src", "dst") <= F.lit(upto))
        found = cut(without_edge(pairs, near).orderBy("a", "b", "via").limit(most))
        if taken < takes or found.count() >= most:
            return found
        takes *= 4


def attribute_join(asserted: DataFrame, entity: DataFrame, edge: DataFrame, most: int = MOST, side: int = SIDE_CLAIMS) -> DataFrame:
    """Shared-dependency hypotheses: the first pairs in order, one for each pair of subjects, with the latest claims of each side."""
    dependency = dependencies(asserted, entity)
    first = first_pairs(dependency, edge, most).groupBy("a", "b").agg(F.min("via").alias("via"))
    latest = Window.partitionBy("subject_entity", "object_entity").orderBy(F.col("observed_at").desc(), "claim_id")
    wanted = first.select(F.col("a").alias("subject_entity"), F.col("via").alias("object_entity")).unionByName(first.select(F.col("b").alias("subject_entity"), F.col("via").alias("object_entity"))).distinct()
    claims = dependency.join(wanted, ["subject_entity", "object_entity"], "left_semi").withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= side)
    sides = claims.groupBy("subject_entity", "object_entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "claim_id"))), lambda x: x["claim_id"]).alias("ids"))
    of_a = sides.select(F.col("subject_entity").alias("a"), F.col("object_entity").alias("via"), F.col("ids").alias("ids_a"))
    of_b = sides.select(F.col("subject_entity").alias("b"), F.col("object_entity").alias("via"), F.col("ids").alias("ids_b"))
    return first.join(of_a, ["a", "via"]).join(of_b, ["b", "via"]).select(
        F.concat_ws("|", "a", "b").alias("hypothesis_id"), "a", "b", "via", F.concat("ids_a", "ids_b").alias("evidence"), F.lit("generated").alias("state"), F.lit("attribute_join_v0").alias("strategy")
    )


def co_mentions(asserted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, together): events in which both occur, for all pairs at once."""
    seen = ends_of(asserted, "event_id").select("entity", "event_id").distinct()
    a = seen.select(F.col("entity").alias("a"), "event_id")
    b = seen.select(F.col("entity").alias("b"), "event_id")
    both = pairs.select("a", "b").distinct().join(a, "a").join(b, ["b", "event_id"])
    counted = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"))
    return pairs.join(counted, ["a", "b"], "left").withColumn("together", F.coalesce("together", F.lit(0)).cast("long"))


def watched_entities(entity: DataFrame, watchlist: DataFrame) -> DataFrame:
    return entity.join(watchlist.filter("active").select("ticker"), "ticker").select("entity_id").distinct()


def funnel(hypotheses: DataFrame, asserted: DataFrame, entity: DataFrame, watchlist: DataFrame, top: int = TOP) -> DataFrame:
    """Scores generated hypotheses; the best become triaged, ties by id."""
    watched = watched_entities(entity, watchlist)
    marked = co_mentions(asserted, hypotheses)
    for side in ("a", "b"):
        marked = marked.join(watched.select(F.col("entity_id").alias(side), F.lit(1).alias(f"_{side}")), side, "left")
    scored = marked.withColumn("score", score.hypothesis_score(F.col("together"), F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0)), F.col("strategy"))).drop("_a", "_b")
    best = scored.filter(F.col("score") >= LEAST_SCORE).orderBy(F.col("score").desc(), "hypothesis_id").limit(top).select("hypothesis_id", F.lit("triaged").alias("_state"))
    return scored.join(best, "hypothesis_id", "left").withColumn("state", F.coalesce("_state", "state")).drop("_state")


def independence(evidence: DataFrame) -> DataFrame:
    """From (hypothesis_id, lineage_id, reliability): independent lineages (the unproven count as one) and whether one is established."""
    lineages = evidence.groupBy("hypothesis_id", "lineage_id").agg(F.max("reliability").alias("reliability"))
    low = F.col("reliability").isNull() | (F.col("reliability") < LOW)
    return lineages.groupBy("hypothesis_id").agg(
        (F.count_if(~low) + F.least(F.count_if(low), F.lit(1))).alias("independent"),
        F.coalesce(F.bool_or(F.col("reliability") >= ESTABLISHED), F.lit(False)).alias("established"),
    )


def verify_gate(verdicts: DataFrame, independent: DataFrame, required: int = REQUIRED) -> DataFrame:
    """What becomes of each verdict: promoted only with enough independent lineages of which one is established."""
    full = verdicts.join(independent, "hypothesis_id", "left").withColumn("independent", F.coalesce("independent", F.lit(0)).cast("long"))
    enough = (F.col("independent") >= required) & F.coalesce("established", F.lit(False))
    state = F.when((F.col("verdict") == "promote") & enough, "promoted").when(F.col("verdict") == "refute", "refuted").otherwise("parked")
    return full.select("hypothesis_id", "independent", state.alias("state"), score.clamp01(F.col("confidence"), 0.5).alias("confidence"))


def wake(parked: DataFrame, asserted: DataFrame) -> DataFrame:
    """Parked hypotheses (hypothesis_id, parked_at, entities) with a claim on one of their entities seen since."""
    watched = parked.select("hypothesis_id", "parked_at", F.explode("entities").alias("entity"))
    latest = ends_of(asserted, "observed_at").groupBy("entity").agg(F.max("observed_at").alias("_last"))
    return watched.join(latest, "entity").filter("_last > parked_at").select("hypothesis_id").distinct()


def _claim_line() -> Column:
    """A claim as a line of JSON; its object is a name, else its literal. The graph's claims have no quote."""
    literal = F.when(F.col("literal_value").isNotNull(), F.struct(F.col("literal_value").alias("value"), F.col("literal_currency").alias("currency"), F.col("literal_as_of").alias("as_of"), F.col("literal_unit").alias("unit")))

    def line(of: Column) -> Column:
        seen = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss").alias("observed_at")
        return F.to_json(F.struct(F.col("claim_id").alias("id"), "subject", F.col("predicate_raw").alias("predicate"), of.alias("object"), F.lit(None).cast("string").alias("quote"), F.col("source_id").alias("source"), seen, "confidence", F.col("lineage_id").alias("lineage")), {"ignoreNullFields": "false"})

    return F.when(F.col("object").isNotNull(), line(F.col("object"))).otherwise(line(literal))


def subgraph(hypotheses: DataFrame, asserted: DataFrame, entity: DataFrame) -> DataFrame:
    """(hypothesis_id, shown, subgraph): the claims around each hypothesis, by id and as lines of JSON, and what is not recorded.

    The latest claims of the evidence come first, oldest first; then the
    latest claims with an end in each subject that are not shown yet, latest
    first. What was not shown before is among the latest ``enough`` claims of
    a subject, so no more of these meet its hypotheses.
    """
    claims = asserted.select("claim_id", "subject_entity", "object_entity", "subject_surface", "object_surface", "predicate_raw", "literal_value", "literal_currency", "literal_as_of", "literal_unit", "source_id", "observed_at", "confidence", "lineage_id")
    newest = [F.col("observed_at").desc(), F.col("claim_id")]
    of_hypothesis = Window.partitionBy("hypothesis_id")
    cited = hypotheses.select("hypothesis_id", F.explode(F.array_distinct("evidence")).alias("claim_id")).join(claims, "claim_id").withColumn("_n", F.row_number().over(of_hypothesis.orderBy(*newest))).filter(F.col("_n") <= EVIDENCE_SHOWN)
    cited = cut(cited.withColumns({"_n": F.row_number().over(of_hypothesis.orderBy("observed_at", "claim_id")), "_part": F.lit(0)}))
    subjects = [hypotheses.select("hypothesis_id", F.col(side).alias("entity")) for side in ("a", "b")]
    enough = EVIDENCE_SHOWN + 2 * SUBJECT_SHOWN
    wanted = subjects[0].unionByName(subjects[1]).select("entity").distinct()
    ends = claims.withColumn("entity", F.explode(F.array_distinct(F.array_compact(F.array("subject_entity", "object_entity"))))).join(wanted, "entity", "left_semi")
    latest = cut(ends.withColumn("_n", F.row_number().over(Window.partitionBy("entity").orderBy(*newest))).filter(F.col("_n") <= enough).drop("_n"))
    shown = cited
    for part, subject in enumerate(subjects, 1):
        more = latest.join(subject, "entity").drop("entity").join(shown.select("hypothesis_id", "claim_id"), ["hypothesis_id", "claim_id"], "left_anti")
        more = more.withColumns({"_n": F.row_number().over(of_hypothesis.orderBy(*newest)), "_part": F.lit(part)}).filter(F.col("_n") <= SUBJECT_SHOWN)
        shown = shown.unionByName(cut(more))
    asked = shown.select(F.explode(F.array("subject_entity", "object_entity")).alias("entity_id")).unionByName(wanted.select(F.col("entity").alias("entity_id"))).distinct()
    names = cut(entity.select("entity_id", "name").join(asked, "entity_id", "left_semi"))
    for of in ("subject", "object"):
        named = names.select(F.col("entity_id").alias(f"{of}_entity"), F.col("name").alias("_name"))
        shown = shown.join(named, f"{of}_entity", "left").withColumn(of, F.coalesce("_name", f"{of}_surface")).drop("_name")
    lines = shown.groupBy("hypothesis_id").agg(F.array_sort(F.collect_list(F.struct("_part", "_n", "claim_id", _claim_line().alias("line")))).alias("_lines"))
    out = hypotheses.select("hypothesis_id", "a", "b").join(lines, "hypothesis_id", "left")
    for side in ("a", "b"):
        out = out.join(names.select(F.col("entity_id").alias(side), F.col("name").alias(f"_{side}")), side, "left")
    joined = lambda field, by: F.array_join(F.transform(F.coalesce("_lines", F.array()), lambda x: x[field]), by)
    missing = F.concat(F.lit("\n\nNo recorded relationship between "), F.coalesce("_a", "a"), F.lit(" and "), F.coalesce("_b", "b"), F.lit("."))
    return out.select("hypothesis_id", joined("claim_id", ",").alias("shown"), F.concat(joined("line", "\n"), missing).alias("subgraph"))
