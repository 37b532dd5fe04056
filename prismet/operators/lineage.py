"""Algebra of recorded lineages: levels, faults carried to descendants, checks of steps, composites and paths, clocks, tails.

States are nodes; a transition leads from its parents to its child over a distance in rounds, which may be unknown. All
tables are keyed by plain columns, so that one run checks the lineages of every bundle at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismet.operators.graph import inner_edges, reached
from prismet.session import written

#: Kinds of transitions that leave the clock where it is (fixed values), and the kind of state that some need at both ends.
TIMELESS = ["curation", "inference_configuration"]
ENDS = {"categorical_reconstruction": "categorical_scenario", "inference_configuration": "model_system", "curation": "corpus"}


def levels(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, level): the longest way to each node from one without parents; null on a cycle or behind one [G5].

    A node gets its level in the round in which the last of its parents got theirs. Rounds are as many as levels; each
    joins only the edges that leave the nodes of the round before, and counts arrivals against what a node waits for: an
    edge that is listed twice arrives twice. Rounds see edges between nodes that have children; all others get their level
    in one pass at the end, from their parents'. ``nodes`` None: the ends of the edges, which are not null.
    """
    pairs = edges.select("src", "dst")
    steps = written(inner_edges(pairs))
    starts = pairs.select(F.col("src").alias("node")).distinct()
    if nodes is not None:  # an end of an edge that is no node is never reached, nor what it leads to
        starts = starts.join(nodes.select("node").distinct(), "node", "left_semi")
    waits = written(starts.join(steps.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_waits")), "node", "left").fillna(0, ["_waits"]))
    ready, level, done = written(waits.where("_waits = 0").select("node")), 0, []
    arrived = None
    while ready.take(1):
        done.append(ready.withColumn("level", F.lit(level)))
        hits = steps.join(ready, steps["src"] == ready["node"]).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
        arrived = hits if arrived is None else arrived.unionByName(hits).groupBy("node").agg(F.sum("_n").alias("_n"))
        arrived = written(arrived)
        full = waits.join(arrived, "node").where("_waits = _n").select("node")
        # What has arrived in full leaves the table, so it holds the nodes that still wait only.
        ready = written(full)
        arrived = arrived.join(ready, "node", "left_anti")
        level += 1
    out = done[0] if done else waits.select("node").limit(0).withColumn("level", F.lit(0))
    for part in done[1:]:
        out = out.unionByName(part)
    # Below: one more than the highest parent, null if one has none. Parents without parents are there by themselves.
    last = pairs.join(out.select(F.col("node").alias("src"), "level"), "src", "left").groupBy(F.col("dst").alias("node"))
    below = last.agg(F.when(F.count("level") == F.count(F.lit(1)), F.max("level") + 1).alias("level"))
    if nodes is None:
        return below.unionByName(done[0] if done else out).where("node IS NOT NULL")
    own = nodes.select("node").distinct().join(below.withColumn("_below", F.lit(True)), "node", "left")
    return own.select("node", F.when(F.col("_below").isNull() & F.col("node").isNotNull(), F.lit(0)).otherwise(F.col("level")).alias("level"))


def carried(faults: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): faulty nodes and all their descendants [G5]: each node once, however many faults reach it."""
    pairs = edges.select("src", "dst")
    inside = reached(faults.select(F.lit(0).alias("origin"), F.col("node")), pairs)
    return inside.select("node").union(pairs.join(inside.select(F.col("node").alias("src")), "src", "left_semi").select("dst")).distinct()


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]))


def step_problems(transitions: DataFrame, parents: DataFrame, contributions: DataFrame, states: DataFrame) -> DataFrame:
    """(transition, codes) of every transition that has a fault of its own [G5, G6].

    transitions: transition, child, kind, process_status, documented, distance, parameter_change, event_time,
    parents_known, has_components; parents and contributions: transition, parent; states: state, kind, checkpoint, time,
    ancestors (null: not known). Null is unknown everywhere.
    """
    s = states.select("state", F.col("kind").alias("state_kind"), "checkpoint", "time", "ancestors", F.lit(True).alias("there"))
    ends = lambda p: s.select(*[F.col(c).alias(f"{p}_{c}") for c in s.columns])
    declared = parents.groupBy("transition").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("parent").alias("_distinct"))
    given = contributions.groupBy("transition").agg(F.count(F.lit(1)).alias("_given"), F.count_distinct("parent").alias("_given_distinct"))
    shared = contributions.distinct().join(parents.distinct(), ["transition", "parent"]).groupBy("transition").agg(F.count(F.lit(1)).alias("_shared"))
    t = transitions.join(ends("child"), F.col("child") == F.col("child_state"), "left")
    t = t.join(declared, "transition", "left").join(given, "transition", "left").join(shared, "transition", "left").fillna(0, ["_n", "_distinct", "_given", "_given_distinct", "_shared"])
    composite, timeless = F.col("kind") == "composite", F.col("kind").isin(*TIMELESS)
    own = _codes(
        (F.col("process_status") != "completed", "transition_not_completed"), (~F.col("documented"), "transition_process_evidence_missing"), (~F.col("parents_known"), "transition_parents_unknown"), (F.col("_n") > F.col("_distinct"), "duplicate_parent"),
        (F.col("child_there").isNull(), "transition_child_unresolved"), (F.col("distance").isNull(), "recursive_distance_unknown"), (timeless & (F.col("distance") != 0), "nonreproduction_clock_increment"),
        (timeless & F.col("parameter_change"), "fixed_parameter_intervention_changed_parameters"), (~composite & ~timeless & (F.col("distance") != 1), "single_transition_distance_must_be_one"), (~composite & F.col("has_components"), "components_on_noncomposite"),
        (F.col("_given") > F.col("_given_distinct"), "duplicate_parent_contribution"), (F.col("parents_known") & (F.col("_shared") < F.col("_given_distinct")), "contribution_not_a_parent"), (F.col("parents_known") & (F.col("_n") > 1) & ((F.col("_shared") < F.col("_distinct")) | (F.col("_shared") < F.col("_given_distinct"))), "merge_contributions_incomplete"),
    )
    both = parents.distinct().join(t.select("transition", "child", "kind", "parameter_change", "event_time", *[f"child_{c}" for c in ("state_kind", "checkpoint", "time", "ancestors", "there")]), "transition").join(ends("parent"), F.col("parent") == F.col("parent_state"), "left")
    wanted = F.lit(None).cast("string")
    for kind, state in ENDS.items():
        wanted = F.when(F.col("kind") == kind, state).otherwise(wanted)
    known = F.col("parent_there") & F.col("child_there")
    models = (F.col("parent_state_kind") == "model_system") & (F.col("child_state_kind") == "model_system")
    relation = _codes(
        (F.col("parent_there").isNull(), "transition_parent_unresolved"), (F.col("parent") == F.col("child"), "reproduction_self_cycle"), (known & ((F.col("parent_state_kind") != wanted) | (F.col("child_state_kind") != wanted)), "transition_state_kind_mismatch"),
        (known & (F.col("kind") == "learning_update") & (F.col("child_state_kind") != "model_system"), "learning_target_not_model_state"), (known & models & ((F.col("parent_checkpoint") != F.col("child_checkpoint")) != F.col("parameter_change")), "parameter_change_identity_conflict"),
        (known & (F.col("parent_time") > F.col("child_time")), "backward_state_time"), (known & ((F.col("event_time") < F.col("parent_time")) | (F.col("event_time") > F.col("child_time"))), "event_outside_state_times"), (known & ~F.array_contains("child_ancestors", F.col("parent")), "child_parent_declaration_conflict"),
    )
    makers = transitions.where(F.col("kind") != "composite").groupBy("child").agg(F.count(F.lit(1)).alias("_makers")).where("_makers > 1")
    several = transitions.where(F.col("kind") != "composite").join(makers, "child", "left_semi").select("transition", F.lit("ambiguous_producing_transition").alias("code"))
    every = t.select("transition", F.explode(own).alias("code")).unionByName(both.select("transition", F.explode(relation).alias("code"))).unionByName(several)
    return every.groupBy("transition").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def composite_problems(transitions: DataFrame, parents: DataFrame, components: DataFrame, faulty: DataFrame) -> DataFrame:
    """(transition, codes) of composites whose stages do not join end to start over the declared distance [G6, G9].

    components: transition (the composite), place, part; faulty: transition, those with a fault of their own. Stages are
    one composite's few rows, in their order; a stage that cannot be found or is itself a composite ends the check of it.
    """
    part = transitions.select(F.col("transition").alias("part"), F.col("child").alias("part_child"), F.col("kind").alias("part_kind"), F.col("distance").alias("part_distance"), (F.col("process_status") == "completed").alias("_completed"), "documented")
    part = part.join(faulty.select(F.col("transition").alias("part"), F.lit(True).alias("_faulty")), "part", "left")
    sets = parents.groupBy("transition").agg(F.array_sort(F.collect_set("parent")).alias("_parents"))
    rows = components.join(part, "part", "left").join(sets.withColumnRenamed("transition", "part").withColumnRenamed("_parents", "_part_parents"), "part", "left")
    w = Window.partitionBy("transition").orderBy("place")
    stop = F.when(F.col("part_kind").isNull(), "composite_stage_unresolved").when(F.col("part_kind") == "composite", "nested_composite_not_supported").when(F.col("part_distance").isNull(), "composite_distance_unknown")
    rows = rows.withColumn("_stop", stop).withColumn("_stopped", F.count("_stop").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("_stopped = 0")
    whole = transitions.where(F.col("kind") == "composite").select("transition", "child", "distance").join(sets, "transition", "left")
    rows = rows.join(whole.select("transition", F.col("_parents").alias("_whole_parents")), "transition")
    first = F.row_number().over(w) == 1
    reached = ~F.coalesce(F.col("_stop").isin("composite_stage_unresolved", "nested_composite_not_supported"), F.lit(False))
    joins = F.coalesce(F.array_contains("_part_parents", F.lag("part_child").over(w)), F.lit(False))
    found = _codes(
        (F.col("_stop").isNotNull(), "-"), (reached & (~F.col("_completed") | ~F.col("documented") | F.coalesce("_faulty", F.lit(False))), "composite_stage_not_documented"),
        (reached & first & ~F.col("_part_parents").eqNullSafe(F.col("_whole_parents")), "composite_parent_mismatch"), (reached & ~first & ~joins, "composite_stage_path_mismatch"),
    )
    each = rows.withColumn("_found", F.array_compact(F.transform(found, lambda c: F.when(c == "-", F.col("_stop")).otherwise(c))))
    total = each.groupBy("transition").agg(F.flatten(F.collect_list("_found")).alias("_found"), F.count("_stop").alias("_stops"), F.sum("part_distance").alias("_total"), F.max_by("part_child", "place").alias("_last"))
    twice = components.groupBy("transition").agg((F.count_distinct("part") < F.count(F.lit(1))).alias("_twice"))
    out = whole.join(total, "transition", "left").join(twice, "transition", "left")
    ends = F.coalesce(F.col("_stops") == 0, F.lit(False)) & ~(F.col("_last").eqNullSafe(F.col("child")) & F.col("_total").eqNullSafe(F.col("distance")))
    codes = F.array_union(F.coalesce("_found", F.array().cast("array<string>")), _codes((F.col("_stops").isNull(), "composite_stages_missing"), (F.coalesce("_twice", F.lit(False)), "duplicate_composite_stage"), (ends, "composite_distance_or_child_mismatch")))
    return out.select("transition", F.array_sort(codes).alias("codes")).where(F.size("codes") > 0)


def path_problems(paths: DataFrame, steps: DataFrame, transitions: DataFrame, parents: DataFrame, restricted: DataFrame) -> DataFrame:
    """(trajectory, codes) of trajectories whose chosen path is not one of the lineage, or whose clock does not fit it [G6, W10].

    paths: trajectory, place, state, coordinate; steps: trajectory, place (of the state it starts from), transition;
    restricted: state, those that a fault reaches.
    """
    w = Window.partitionBy("trajectory").orderBy("place")
    nxt = paths.select("trajectory", "place", "state", "coordinate", F.lead("state").over(w).alias("_next"), F.lead("coordinate").over(w).alias("_next_at"))
    known = transitions.select("transition", "child", "distance", F.lit(True).alias("_there"))
    edge = steps.join(known, "transition", "left")
    rows = nxt.join(edge, ["trajectory", "place"], "left")
    rows = rows.join(parents.distinct().select("transition", F.col("parent").alias("state"), F.lit(True).alias("_from")), ["transition", "state"], "left")
    rows = rows.join(restricted.select(F.col("state").alias("_next"), F.lit(True).alias("_held")), "_next", "left")
    there = F.col("_there") & F.col("_next").isNotNull()
    codes = _codes(
        (F.col("coordinate").isNull(), "trajectory_clock_unresolved"), (F.col("transition").isNotNull() & F.col("_there").isNull(), "trajectory_transition_unresolved"), (there & (F.col("_from").isNull() | (F.col("child") != F.col("_next"))), "selected_branch_path_mismatch"),
        (there & F.col("_held"), "trajectory_lineage_restricted"), (there & (F.col("_next_at") - F.col("coordinate") != F.col("distance")), "trajectory_clock_distance_mismatch"),
    )
    sizes = paths.groupBy("trajectory").agg(F.count(F.lit(1)).alias("_states"), F.count_distinct("state").alias("_distinct"))
    edges = steps.groupBy("trajectory").agg(F.count(F.lit(1)).alias("_steps"), F.count_distinct("transition").alias("_steps_distinct"))
    shape = sizes.join(edges, "trajectory", "left").fillna(0, ["_steps", "_steps_distinct"])
    uneven = F.col("_steps") != F.col("_states") - 1
    own = shape.select("trajectory", uneven.alias("_uneven"), _codes((F.col("_distinct") < F.col("_states"), "trajectory_repeated_state"), (F.col("_steps_distinct") < F.col("_steps"), "trajectory_repeated_transition"), (uneven, "trajectory_path_lengths")).alias("_own"))
    # A path of uneven lengths is not followed.
    found = rows.join(own.where("NOT _uneven").select("trajectory"), "trajectory", "left_semi").select("trajectory", F.explode(codes).alias("code"))
    every = found.unionByName(own.select("trajectory", F.explode("_own").alias("code")))
    return every.groupBy("trajectory").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def elapsed(paths: DataFrame, steps: DataFrame, transitions: DataFrame, parents: DataFrame, asked: DataFrame) -> DataFrame:
    """request, start_at, end_at, rounds, reasons: the clock between two states of a path, and why there is none [W10, G6].

    asked: request, trajectory, start, end; transitions also tell whether they are ``sound``. Between the two states every
    step must be a sound transition of this branch with a known distance, and their sum the difference of the coordinates.
    One join for a path's steps and one aggregation for each request; no path is walked.
    """
    place = paths.groupBy("trajectory", "state").agg(F.min("place").alias("_place"), F.min_by("coordinate", "place").alias("_at"))
    end = lambda p: place.select("trajectory", F.col("state").alias(p), F.col("_place").alias(f"_{p}"), F.col("_at").alias(f"{p}_at"))
    q = asked.join(end("start"), ["trajectory", "start"], "left").join(end("end"), ["trajectory", "end"], "left")
    ordered = F.coalesce(F.col("_end") > F.col("_start"), F.lit(False))
    w = Window.partitionBy("trajectory").orderBy("place")
    each = paths.select("trajectory", "place", "state", F.lead("state").over(w).alias("_next")).join(steps, ["trajectory", "place"], "left").join(transitions.select("transition", "child", "distance", "sound"), "transition", "left")
    each = each.join(parents.distinct().select("transition", F.col("parent").alias("state"), F.lit(True).alias("_from")), ["transition", "state"], "left")
    sound = F.coalesce("sound", F.lit(False))
    each = each.select("trajectory", "place", sound.alias("_sound"), (F.col("_from").isNull() | ~F.col("child").eqNullSafe(F.col("_next"))).alias("_astray"), "distance")
    inside = q.where(ordered).select("request", "trajectory", "_start", "_end").join(each, "trajectory").where("place >= _start AND place < _end")
    summed = inside.groupBy("request").agg(F.bool_or(~F.col("_sound")).alias("_open"), F.bool_or(F.col("_sound") & F.col("_astray")).alias("_astray"), F.bool_or(F.col("_sound") & F.col("distance").isNull()).alias("_unknown"), F.coalesce(F.sum(F.when(F.col("_sound"), F.col("distance"))), F.lit(0)).alias("_sum"))
    out = q.join(summed, "request", "left")
    missing = F.col("start_at").isNull() | F.col("end_at").isNull()
    why = F.when(~ordered, F.array(F.lit("selected_path_order_mismatch"))).otherwise(_codes(
        (missing | F.col("_unknown"), "recursive_distance_unresolved"), (F.col("_open"), "transition_history_unresolved"), (F.col("_astray"), "selected_branch_mismatch"), (~missing & (F.col("end_at") - F.col("start_at") != F.col("_sum")), "recursive_distance_mismatch"),
    ))
    return out.select("request", F.when(ordered, F.col("start_at")).alias("start_at"), F.when(ordered, F.col("end_at")).alias("end_at"), F.when(F.size(why) == 0, F.col("end_at") - F.col("start_at")).alias("rounds"), F.array_sort(why).alias("reasons"))


def tail_ledger(asked: DataFrame, tails: DataFrame, links: DataFrame, *, limit: int) -> tuple[DataFrame, DataFrame]:
    """Members and gates of protected tails, in the order of a first-in-first-out walk along their references [G9].

    asked: request, tail, registry (that its measurements use); tails: tail, class_known, designation, basis, state,
    disposition, registries (array), registered (the registration is sound), registration, listed (it lists the tail),
    reviews, reviews_readable, mock; links: tail, place, target. Members: request, place, tail, codes, availability, mock;
    gates: request, status, reasons. A walk that would pass ``limit`` members stops there and says so.

    The walk is one recursive query whose path column keeps the order: a member comes where its first path in breadth
    order puts it. Cycles end, since no path visits a member twice.
    """
    spark = asked.sparkSession
    seeds = asked.where(F.col("tail").isNotNull()).select("request", "tail")
    names = {k: f"_prismet_{k}_{id(asked)}" for k in ("seeds", "links")}
    seeds.createOrReplaceTempView(names["seeds"])
    links.select("tail", F.col("place").cast("int").alias("place"), "target").createOrReplaceTempView(names["links"])
    walked = spark.sql(f"""WITH RECURSIVE w (request, tail, depth, path, seen) MAX RECURSION LEVEL {limit + 1} AS (
        SELECT request, tail, 0, CAST(array() AS array<int>), array(tail) FROM {names["seeds"]}
        UNION ALL SELECT w.request, l.target, depth + 1, array_append(path, l.place), array_append(seen, l.target) FROM w JOIN {names["links"]} l ON l.tail = w.tail WHERE depth < {limit} AND NOT array_contains(seen, l.target))
        SELECT request, tail, min(struct(depth, path)) AS at FROM w GROUP BY request, tail""")
    walked = written(walked)
    for name in names.values():
        spark.catalog.dropTempView(name)
    order = F.row_number().over(Window.partitionBy("request").orderBy("at"))
    ranked = walked.withColumn("place", order - 1)
    held = ranked.where(F.col("place") < limit).join(asked.select("request", "registry"), "request").join(tails, "tail", "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    gone = F.col("state").isNull()
    mismatch = (F.size("registries") != 1) | (F.col("registry").isNotNull() & ~F.get("registries", F.lit(0)).eqNullSafe(F.col("registry")))
    codes = F.when(gone, F.array(F.lit("tail_record_unavailable"))).otherwise(_codes(
        (~F.coalesce("class_known", F.lit(False)), "tail_class_identity_unresolved"), (blank(F.col("designation")), "tail_designation_unresolved"), (blank(F.col("basis")), "tail_rationale_unresolved"), ((F.col("state") != "active") | ~F.col("disposition").eqNullSafe(F.lit("protected")), "tail_not_currently_protected"),
        (mismatch, "tail_registry_mismatch_or_missing"), (~F.coalesce("registered", F.lit(False)), "registration_unresolved"), (F.col("registration").isNull() | ~F.coalesce("listed", F.lit(False)), "tail_not_in_registered_materials"),
    ))
    available = F.when(gone, "unavailable").when(F.col("reviews") == 0, "not_supplied").when(F.col("reviews") == F.col("reviews_readable"), "records_available_only").otherwise("unavailable")
    members = written(held.select("request", "place", "tail", codes.alias("codes"), available.alias("availability"), F.coalesce("mock", F.lit(False)).alias("mock")))
    over = ranked.where(F.col("place") >= limit).select("request").distinct().withColumn("_over", F.lit(True))
    found = members.groupBy("request").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("_codes"))
    gates = asked.select("request", "tail").join(found, "request", "left").join(over, "request", "left")
    why = F.when(F.col("tail").isNull(), F.array(F.lit("protected_tail_not_declared"))).otherwise(F.array_sort(F.concat("_codes", _codes((F.coalesce("_over", F.lit(False)), "tail_link_limit")))))
    return members, gates.select("request", F.when(F.col("tail").isNull(), "not_requested").when(F.size(why) > 0, "unresolved").otherwise("eligible").alias("status"), why.alias("reasons"))
