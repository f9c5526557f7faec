"""Append-only review and outcome ledgers as tables: a batch in, rows to append out.

Where single requests would be handled one by one, a batch is processed in ``position`` order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worksift import config
from worksift.config import MAX_PAGE_SIZE
from worksift.functions.money import quota_for
from worksift.functions.text import stripped
from worksift.plans.ranking import dense_position, global_rank, position_blocks, rank_in_group, running_totals
from worksift.plans.storage import written

# Review decisions, and the finders behind each kind of candidate.
REVIEW_STATUSES = ("confirmed_same", "rejected_different")
ALIAS_REVIEW_STATUSES = ("confirmed_merge", "rejected_distinct")
KIND_FINDERS = {
    "identical": ("identical_batch", "district_identical_batch"),
    "judged": (config.JUDGED_FINDER,),
}


# -- reviews ----------------------------------------------------------------------------------


def current_reviews(reviews: DataFrame) -> DataFrame:
    """The review in force per candidate: not superseded, newest id."""
    later = reviews.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("review_id"))
    columns = [c for c in reviews.columns if c != "candidate_id"]
    standing = reviews.join(later, "review_id", "left_anti")
    newest = standing.groupBy("candidate_id").agg(F.max_by(F.struct(*columns), "review_id").alias("current_review"))
    return newest


def review_resolve(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Candidates with ``current_review`` and ``current_status`` (``pending`` without one)."""
    joined = candidates.join(current_reviews(reviews), "candidate_id", "left")
    return joined.withColumn("current_status", F.coalesce("current_review.status", F.lit("pending")))


def candidate_upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """The candidate table after a batch: known keys keep their id and take the new values, new
    keys get the next ids in ``position`` order. The last row of a repeated key wins."""
    values = [c for c in incoming.columns if c not in (*key, "position")]
    ordered = incoming
    if "fingerprint_a" in key:
        low, high = F.least("fingerprint_a", "fingerprint_b"), F.greatest("fingerprint_a", "fingerprint_b")
        ordered = incoming.withColumns({"fingerprint_a": low, "fingerprint_b": high})
    last = ordered.groupBy(*key).agg(
        F.max_by(F.struct(*values), "position").alias("_new"), F.min("position").alias("_first")
    )
    old = existing.select(*key, "candidate_id", F.struct(*values).alias("_old"))
    merged = last.join(old, list(key), "full_outer")
    value = F.coalesce("_new", "_old")
    known = merged.where(F.col("candidate_id").isNotNull())
    fresh = global_rank(merged.where(F.col("candidate_id").isNull()), [F.col("_first"), *[F.col(k) for k in key]], "_n")
    top = existing.agg(F.coalesce(F.max("candidate_id"), F.lit(0)).alias("_top"))
    fresh = fresh.crossJoin(F.broadcast(top)).withColumn("candidate_id", F.col("_top") + F.col("_n"))  # one row
    out = ["candidate_id", *key, *[value[v].alias(v) for v in values]]
    return known.select(*out).unionByName(fresh.select(*out))


def review_append(
    candidates: DataFrame,
    reviews: DataFrame,
    decisions: DataFrame,
    statuses: Sequence[str] = REVIEW_STATUSES,
) -> DataFrame:
    """Decisions with ``problem`` (null when accepted) and, for accepted ones, the new
    ``review_id`` and the review it supersedes: the one before it in the batch, or else the one in
    force."""
    known = candidates.select("candidate_id", F.lit(True).alias("_known"))
    blank = F.coalesce(stripped(F.col("reviewed_by")) == "", F.lit(True))
    problem = (
        F.when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "unknown_status")
        .when(blank, "blank_reviewer")
        .when(F.col("_known").isNull(), "candidate_not_found")
    )
    checked = written(
        decisions.join(known, "candidate_id", "left").withColumn("problem", problem).drop("_known"), "decisions"
    )
    accepted = global_rank(checked.where(F.col("problem").isNull()), [F.col("position")], "_n")
    top = reviews.agg(F.coalesce(F.max("review_id"), F.lit(0)).alias("_top"))
    accepted = accepted.crossJoin(F.broadcast(top)).withColumn("review_id", F.col("_top") + F.col("_n"))  # one row
    # The decision before on the same candidate, by position in the candidate's own order.
    chained = rank_in_group(accepted.drop("_n", "_top"), ["candidate_id"], [F.col("review_id")], "_step")
    chained = written(chained, "chained")
    previous = chained.select("candidate_id", (F.col("_step") + 1).alias("_step"), F.col("review_id").alias("_previous"))
    current = current_reviews(reviews).select("candidate_id", F.col("current_review.review_id").alias("_current"))
    linked = chained.join(previous, ["candidate_id", "_step"], "left").join(current, "candidate_id", "left")
    linked = linked.withColumn("supersedes", F.coalesce("_previous", "_current")).drop("_step", "_previous", "_current")
    refused = checked.where(F.col("problem").isNotNull()).withColumns(
        {"review_id": F.lit(None).cast("bigint"), "supersedes": F.lit(None).cast("bigint")}
    )
    return linked.withColumn("reviewed_by", stripped(F.col("reviewed_by"))).unionByName(refused, allowMissingColumns=True)


def review_history(reviews: DataFrame, candidate_id: int | None = None) -> DataFrame:
    """Reviews oldest first, of one candidate or grouped by candidate."""
    rows = reviews if candidate_id is None else reviews.where(F.col("candidate_id") == candidate_id)
    return rows.orderBy("candidate_id", "review_id")


def candidate_page(
    resolved: DataFrame, status: str | None = None, kind: str | None = None, page: int = 1, page_size: int = 50
) -> tuple[DataFrame, DataFrame]:
    """One page by candidate id, and the filtered total.

    Candidates are counted per block of ids; only the blocks under the page are put in order.
    """
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page from 1, page_size from 1 to {MAX_PAGE_SIZE}; got {page}, {page_size}")
    rows = resolved
    if status is not None:
        rows = rows.where(F.col("current_status") == status)
    if kind is not None:
        rows = rows.where(F.col("finder").isin(*KIND_FINDERS[kind]))
    blocks = written(position_blocks(rows, "candidate_id"), "blocks")
    total = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / page_size).cast("bigint")
    )
    first = (page - 1) * page_size
    under = blocks.where((F.col("start") < first + page_size) & (F.col("start") + F.col("rows") > first))
    placed = dense_position(rows, "candidate_id", under, "_place")
    return placed.where(F.col("_place").between(first + 1, first + page_size)).drop("_place"), total


def candidate_evidence(page: DataFrame, candidate_works: DataFrame, works: DataFrame) -> DataFrame:
    """The works behind a page of candidates, those the works table knows, in work id order."""
    wanted = candidate_works.join(page.select("candidate_id"), "candidate_id", "left_semi")
    return wanted.join(works, "work_id")


# What a judged candidate has besides its first text; null for batches.
_JUDGED = ("text_b", "quote_a", "quote_b", "work_relation")


def duplicate_context(
    candidate_works: DataFrame, resolved: DataFrame, works: DataFrame | None = None, groups: DataFrame | None = None
) -> DataFrame:
    """Candidates containing each work (all works, or those of ``works``): what was found, both texts,
    quotes and the relation where a pair was judged, the status, the number of works, and ``place``, the
    newest candidate of a work first. Other members come from ``other_works``; repeating them per work
    would be every pair. With ``groups`` (``scope, fingerprint, text``), texts are read there, for the rows that
    are left, and ``resolved`` needs the scope and fingerprints of its sides only."""
    sizes = written(candidate_works.groupBy("candidate_id").agg(F.count("*").alias("work_count")), "sizes")
    rows = candidate_works if works is None else candidate_works.join(works.select("work_id"), "work_id", "left_semi")
    blank = lambda c: F.col(c) if c in resolved.columns else F.lit(None).cast("string").alias(c)
    sides = ["scope", "fingerprint_a", "fingerprint_b"]
    details = resolved.select(
        "candidate_id", "finder", "threshold_crossing_batch",
        *(["text", *[blank(c) for c in _JUDGED]] if groups is None else [*sides, *[blank(c) for c in _JUDGED if c != "text_b"]]),
        F.col("current_status").alias("status"),
    )
    # Written, so that its size is known: for a few works the texts of all candidates are not shuffled.
    placed = written(rank_in_group(rows.select("work_id", "candidate_id"), ["work_id"], [F.col("candidate_id").desc()], "place"), "placed")
    out = (
        placed.join(sizes, "candidate_id")
        .join(details, "candidate_id")
        .withColumn("other_work_count", F.col("work_count") - 1)
    )
    if groups is None:
        return out
    side = lambda s, name: groups.select("scope", F.col("fingerprint").alias(f"fingerprint_{s}"), F.col("text").alias(name))
    shown = out.join(side("a", "text"), sides[:2], "left").join(side("b", "text_b"), [sides[0], sides[2]], "left")
    return shown.withColumn("text_b", F.when(F.col("finder") == config.JUDGED_FINDER, F.col("text_b"))).drop(*sides)


def candidate_members(candidate_works: DataFrame) -> DataFrame:
    """``candidate_id, work_id, place``: the works of each candidate in work id order, as rows."""
    return rank_in_group(candidate_works.select("candidate_id", "work_id"), ["candidate_id"], [F.col("work_id")], "place")


def other_works(members: DataFrame, works: DataFrame) -> DataFrame:
    """``work_id, candidate_id, other_work_id, place``: what shares a candidate with each of a few
    ``works``, ranked per candidate without the work itself. ``members`` comes from ``candidate_members``."""
    own = members.join(works.select("work_id"), "work_id", "left_semi")
    asked = own.select("candidate_id", "work_id", F.col("place").alias("_own"))
    others = members.select("candidate_id", F.col("work_id").alias("other_work_id"), F.col("place").alias("_place"))
    met = others.join(asked, "candidate_id").where("other_work_id <> work_id")
    return met.select(
        "work_id", "candidate_id", "other_work_id", (F.col("_place") - (F.col("_place") > F.col("_own")).cast("int")).alias("place")
    )


# -- inspection outcomes ----------------------------------------------------------------------


_TRIPLE = ["work_id", "inspected_on", "inspector_id"]


def outcome_accept(ledger: DataFrame, batch: DataFrame, works: DataFrame, today: Column) -> DataFrame:
    """Batch rows with ``reason``: null when accepted, else the first rule broken.

    Rules: a position and an id, a known work, a known outcome, a date not in the future, an amended outcome that
    exists for the same work and is not amended yet, and one row per work, day and inspector.

    Most rows share nothing with an amendment and are decided at once, the first of each triple. The
    others depend on earlier rows through a shared triple or the row they amend. Each round decides
    those whose key is settled, and with them whole chains of amendments: a row that only waits for the row
    it amends takes over that row's pointer, doubling its reach, until it points at a row that is decided.
    """
    known = works.select("work_id", F.lit(True).alias("_known"))
    outcomes = list(config.OUTCOME_IS_ISSUE)
    own = (
        F.when(F.col("position").isNull() | F.col("outcome_id").isNull(), "no_position")
        .when(F.col("_known").isNull(), "work_not_found")
        .when(~F.coalesce(F.col("outcome").isin(*outcomes), F.lit(False)), "unknown_outcome")
        .when(F.col("inspected_on").isNull() | (F.col("inspected_on") > today), "bad_date")
        .when(F.coalesce(stripped(F.col("inspector_id")) == "", F.lit(True)), "blank_inspector")
    )
    rows = written(
        batch.join(known, "work_id", "left").withColumn("reason", own).drop("_known"), "outcomes"
    )
    ids = ["outcome_id", *_TRIPLE, "supersedes", "position"]
    sound = rows.where(F.col("reason").isNull()).select(*ids)
    # Rows of the ledger come before all of the batch: they have no position.
    before = F.lit(None).cast(dict(batch.dtypes)["position"]).alias("position")
    recorded = written(ledger.select(*ids[:-1], before, F.lit(True).alias("accepted")), "ledger")
    entangled = written(sound.where("supersedes is not null").select(*_TRIPLE).distinct(), "entangled")
    alone = written(_first_of_triples(sound.join(entangled, _TRIPLE, "left_anti"), recorded), "alone")
    refused = rows.where(F.col("reason").isNotNull())
    verdicts = refused.where(F.col("outcome_id").isNotNull()).select("outcome_id", "reason").unionByName(alone.select("outcome_id", "reason"))
    settled = (
        recorded.unionByName(refused.select(*ids, F.lit(False).alias("accepted")))
        .unionByName(alone.select(*ids, F.col("reason").isNull().alias("accepted")))
    )
    open_rows = written(sound.join(entangled, _TRIPLE, "left_semi"), "open")
    settled = written(_concerned(settled, open_rows), "settled")
    while not open_rows.isEmpty():
        decided = written(_decided(open_rows, settled), "decided")
        if decided.isEmpty():
            raise RuntimeError("no open outcome can be decided: positions are not unique")
        verdicts = verdicts.unionByName(decided.select("outcome_id", "reason"))
        settled = settled.unionByName(decided.select(*ids, F.col("reason").isNull().alias("accepted")))
        open_rows = written(open_rows.join(decided.select("outcome_id"), "outcome_id", "left_anti"), "open")
    # Rows without an id cannot be joined to a verdict; theirs is known.
    unnamed = rows.where(F.col("outcome_id").isNull())
    return rows.drop("reason").join(verdicts, "outcome_id").unionByName(unnamed, allowMissingColumns=True)


def _first_of_triples(rows: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows of triples that hold no amendment: the first is accepted where the ledger has none."""
    first = rows.groupBy(*_TRIPLE).agg(F.min("position").alias("_first"))
    taken = recorded.select(*_TRIPLE).distinct().withColumn("_taken", F.lit(True))
    late = (F.col("position") > F.col("_first")) | F.col("_taken").isNotNull()
    joined = rows.join(first, _TRIPLE).join(taken, _TRIPLE, "left")
    return joined.withColumn("reason", F.when(late, "duplicate_outcome")).drop("_first", "_taken")


def _concerned(settled: DataFrame, open_rows: DataFrame) -> DataFrame:
    """The settled rows that an open row can depend on: its triple's, its target, and what amends that."""
    targets = written(open_rows.where("supersedes is not null").select(F.col("supersedes").alias("outcome_id")).distinct(), "targets")
    triples = open_rows.select(*_TRIPLE).distinct()
    amending = targets.withColumnRenamed("outcome_id", "supersedes")
    tagged = (
        settled.join(triples.withColumn("_a", F.lit(True)), _TRIPLE, "left")
        .join(targets.withColumn("_b", F.lit(True)), "outcome_id", "left")
        .join(amending.withColumn("_c", F.lit(True)), "supersedes", "left")
    )
    return tagged.where("_a or _b or _c").select(*settled.columns)


def _decided(open_rows: DataFrame, settled: DataFrame) -> DataFrame:
    """One round: ``open_rows`` that can be decided, with ``reason``."""
    kept = settled.where("accepted")
    taken = kept.select(*_TRIPLE).distinct().withColumn("_taken", F.lit(True))
    amended = kept.where(F.col("supersedes").isNotNull()).select("supersedes").distinct().withColumn("_amended", F.lit(True))
    first = open_rows.groupBy(*_TRIPLE).agg(F.min("position").alias("_first"))
    marked = written(open_rows.join(first, _TRIPLE).join(taken, _TRIPLE, "left"), "marked")
    # Rows that amend nothing meet no other row through ``supersedes``: they stay out of its joins.
    amending, plain = marked.where("supersedes is not null"), marked.where("supersedes is null")
    first_amend = amending.groupBy("supersedes").agg(F.min("position").alias("_first_amend"))
    target = settled.where("outcome_id is not null").select(
        F.col("outcome_id").alias("supersedes"), F.col("work_id").alias("_target_work"), F.col("accepted").alias("_target_ok"),
        F.col("position").alias("_settled_position"),
    )
    # A row whose triple is taken is refused whatever it amends: what amends it need not wait.
    waiting = marked.select(
        F.col("outcome_id").alias("supersedes"), F.col("position").alias("_target_position"),
        F.col("work_id").alias("_open_work"), F.col("_taken").isNotNull().alias("_target_lost"),
    )
    linked = (
        amending.join(first_amend, "supersedes", "left")
        .join(amended, "supersedes", "left")
        .join(target, "supersedes", "left")
        .join(waiting, "supersedes", "left")
    )
    view = linked.unionByName(plain, allowMissingColumns=True)
    amends, of_triple = F.col("supersedes").isNotNull(), F.col("position") == F.col("_first")
    # Open rows before this one that may yet be accepted, and belong to its work.
    waits = F.coalesce(
        (F.col("_target_position") < F.col("position")) & ~F.col("_target_lost") & (F.col("_open_work") == F.col("work_id")), F.lit(False)
    )
    of_target = F.col("_amended").isNotNull() | (F.col("position") == F.col("_first_amend"))
    earlier = F.col("_settled_position").isNull() | (F.col("_settled_position") < F.col("position"))
    valid_target = F.coalesce(F.col("_target_ok") & (F.col("_target_work") == F.col("work_id")) & earlier, F.lit(False))
    reason = (
        F.when(amends & ~valid_target, "invalid_supersedes")
        .when(amends & F.col("_amended").isNotNull(), "already_superseded")
        .when(F.col("_taken").isNotNull(), "duplicate_outcome")
    )
    doomed = amends & ~waits & ~valid_target  # whatever else holds
    lost = F.col("_taken").isNotNull()
    ready = doomed | ((lost | of_triple) & (~amends | (~waits & of_target)))
    columns = open_rows.columns
    # Rows that wait for the row they amend. Below a refused row all are refused. Below an accepted one
    # a row is accepted if it and all between are the first of their triple and the first amendment of
    # their target. A row whose triple is taken waits in the same way for its reason.
    strong = (lost | of_triple) & (F.col("position") == F.col("_first_amend"))
    seen = view.select(*columns, reason.alias("reason"), ready.alias("_ready"), (amends & waits).alias("_waits"), lost.alias("_lost"), strong.alias("_strong"))
    seen = written(seen.where("_ready or _waits"), "view")
    now = seen.where("_ready").select(*columns, "reason")
    chain = seen.where("_waits").select(*columns, "_lost", "_strong")
    if chain.isEmpty():
        return now
    ends = _ends(chain.select("outcome_id", "supersedes", "_strong"))
    fate = now.select(F.col("outcome_id").alias("_end"), F.col("reason").isNull().alias("_ok"))
    verdict = F.when(~F.col("_ok"), "invalid_supersedes").when(F.col("_lost"), "duplicate_outcome")
    chained = chain.drop("_strong").join(ends, "outcome_id").join(fate, "_end").where("_strong or not _ok")
    return now.unionByName(chained.select(*columns, verdict.alias("reason")))


def _ends(links: DataFrame) -> DataFrame:
    """``outcome_id, _end, _strong``: where each row's chain of ``supersedes`` leaves ``links``, and whether
    all links up to there are strong. Every row points at its target first and at its target's target's
    pointer from then on, so a chain of n rows takes log n rounds."""
    steps = written(links.select("outcome_id", F.col("supersedes").alias("_end"), "_strong"), "steps")
    while True:
        further = steps.select(F.col("outcome_id").alias("_end"), F.col("_end").alias("_next"), F.col("_strong").alias("_further"))
        stepped = written(
            steps.join(further, "_end", "left").select(
                "outcome_id", F.coalesce("_next", "_end").alias("_end"), (F.col("_strong") & F.coalesce("_further", F.lit(True))).alias("_strong"),
                F.col("_next").isNotNull().alias("_moved"),
            ),
            "steps",
        )
        steps = stepped.drop("_moved")
        if stepped.where("_moved").isEmpty():
            return steps


def outcome_context(works: DataFrame, scored: DataFrame) -> DataFrame:
    """Per work: its place among the works under implementation of its own authority, that
    population and its quota. A work outside the population gets the place it would take; works
    without an authority are one group."""
    authority = "implementing_district_authority"
    rows = works.join(scored.select("work_id", "risk_score"), "work_id").select(
        "work_id",
        authority,
        "risk_score",
        F.col("completion_status").isin(*config.UNDER_IMPLEMENTATION).cast("bigint").alias("_in"),
    )
    order = [F.col(authority), F.col("risk_score").desc(), F.col("work_id")]
    placed = written(running_totals(global_rank(rows, order, "_n"), "_n", {"_upto": "_in"}), "places")
    groups = placed.groupBy(F.col(authority).alias("_authority")).agg(
        F.sum("_in").alias("population_n_at_time"),
        F.min(F.col("_upto") - F.col("_in")).alias("_before"),
    )
    joined = placed.join(groups, F.col(authority).eqNullSafe(F.col("_authority")))
    return joined.select(
        "work_id",
        authority,
        F.col("risk_score").alias("risk_score_at_time"),
        (F.col("_upto") - F.col("_in") - F.col("_before") + 1).alias("inspection_rank_at_time"),
        "population_n_at_time",
        quota_for(F.col("population_n_at_time")).alias("cutoff_rank_at_time"),
    )


def outcome_read(outcomes: DataFrame) -> DataFrame:
    """Rows of the first layout hold the authority in the agency column; serve it as such."""
    old = F.col("context_version") == 1
    return outcomes.withColumns(
        {
            "implementing_district_authority": F.when(old, F.col("implementing_agency")).otherwise(
                F.col("implementing_district_authority")
            ),
            "implementing_agency": F.when(~old, F.col("implementing_agency")),
        }
    )


def outcome_history(outcomes: DataFrame, work_id: str | None = None) -> DataFrame:
    rows = outcomes if work_id is None else outcomes.where(F.col("work_id") == work_id)
    return outcome_read(rows).orderBy("work_id", "inspected_on", "outcome_id")


def outcome_list(outcomes: DataFrame) -> DataFrame:
    """Every outcome with whether a later one amends it."""
    later = outcomes.where(F.col("supersedes").isNotNull()).select(
        F.col("supersedes").alias("outcome_id"), F.lit(True).alias("_later")
    )
    return outcomes.join(later.distinct(), "outcome_id", "left").withColumn(
        "superseded", F.coalesce("_later", F.lit(False))
    ).drop("_later")


def _is_issue(outcome: Column) -> Column:
    chain = F
    for name, issue in config.OUTCOME_IS_ISSUE.items():
        chain = chain.when(outcome == name, F.lit(issue))
    return chain.otherwise(None)


def outcome_groups(outcomes: DataFrame) -> DataFrame:
    """Counts of current outcomes for the ranked list and the spot checks; outcomes that never
    reached the work are in neither numerator nor denominator."""
    issue = _is_issue(F.col("outcome"))
    current = outcome_list(outcomes).where(~F.col("superseded"))
    counted = current.groupBy("in_control_sample").agg(
        F.count("*").alias("n"),
        F.count(issue).alias("reached_work"),
        F.count_if(issue).alias("issues"),
        F.count_if(F.col("inspection_rank_at_time") <= F.col("cutoff_rank_at_time")).alias("within_quota"),
    )
    return counted.select(
        F.when(F.col("in_control_sample"), "spot_check").otherwise("ranked").alias("group"),
        *[c for c in counted.columns if c != "in_control_sample"],
    )


def wilson_rate(groups: DataFrame) -> DataFrame:
    """Adds the issue rate with its 95% Wilson interval where enough works were reached, and
    whether both groups have one."""
    n = F.nullif(F.col("reached_work").cast("double"), F.lit(0.0))
    p = F.col("issues") / n
    z2 = config.WILSON_Z**2
    scale = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / scale
    margin = config.WILSON_Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / scale
    enough = F.col("reached_work") >= config.MIN_REACHED_PER_GROUP
    rated = groups.withColumns(
        {
            "issue_rate": F.when(enough, p),
            "rate_low": F.when(enough, F.greatest(F.lit(0.0), centre - margin)),
            "rate_high": F.when(enough, F.least(F.lit(1.0), centre + margin)),
        }
    )
    ready = rated.agg((F.count("issue_rate") == 2).alias("comparison_ready"))
    return rated.crossJoin(F.broadcast(ready))  # two rows by one
