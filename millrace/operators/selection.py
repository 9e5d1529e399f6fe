"""Choosing among found elements: duplicates, containment, budgets, rounds of refinement, tool calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import intervals
from .graph import work_folder, written


#: Rows of a group that are folded as one array.
FOLD_ROWS = 2_000


def lines_of(start: Column, end: Column) -> Column:
    """end - start + 1 if end > start, else 0."""
    return F.when(end > start, end - start + 1).otherwise(F.lit(0))


def total_lines(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(lines_of(F.col("start_line"), F.col("end_line"))), F.lit(0)).alias("total_lines"))


def priority(rows: DataFrame) -> DataFrame:
    """priority: relevance, source, type, size and granularity in one number."""
    n = F.when(F.col("end_line") > F.col("start_line"), F.col("end_line") - F.col("start_line") + 1).otherwise(F.lit(100))
    source = F.when(F.col("agent_found"), 0.3).when(F.col("llm_file_selected"), 0.2).when(F.col("semantic_score") > 0.7, 0.15).otherwise(0.0)
    kind = F.when(F.col("type") == "function", 0.2).when(F.col("type") == "class", 0.15).otherwise(0.0)
    size = F.when(n < 50, 0.8).when(n <= 200, 1.0).when(n <= 500, 0.7).otherwise(0.5)
    precise = F.when(F.col("selection_granularity").isin("class", "function"), 0.15).otherwise(0.0)
    return rows.withColumn("priority", F.coalesce(F.col("total_score"), F.lit(0.5)) * 0.4 + source + kind + size * 0.2 + precise)


def _folded_whole(rows: DataFrame, key: Column, budget: int, least: int) -> DataFrame:
    """The pass over each group as one array, for groups of a bounded size."""
    lines = lines_of(F.col("start_line"), F.col("end_line")).cast("long")
    items = rows.select(key.alias("__group"), F.struct((-F.col("priority")).alias("order"), F.col("id"), lines.alias("lines")).alias("item"))
    start = F.struct(F.array().cast(ArrayType(rows.schema["id"].dataType)).alias("ids"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("done"))

    def step(s, x):
        fits = (F.size(s["ids"]) == 0) | (s["used"] + x["lines"] <= budget)
        take = ~s["done"] & fits
        return F.struct(F.when(take, F.concat(s["ids"], F.array(x["id"]))).otherwise(s["ids"]).alias("ids"), F.when(take, s["used"] + x["lines"]).otherwise(s["used"]).alias("used"), (s["done"] | (~fits & (F.size(s["ids"]) >= least))).alias("done"))

    taken = items.groupBy("__group").agg(F.aggregate(F.array_sort(F.collect_list("item")), start, step, lambda s: s["ids"]).alias("ids"))
    kept = taken.select("__group", F.explode("ids").alias("id"))
    return rows.withColumn("__group", key).join(kept, ["__group", "id"], "left_semi").drop("__group")


def prune_to_budget(rows: DataFrame, budget: int, group: str | None = None, least: int = 5) -> DataFrame:
    """The rows of each group that a greedy pass by priority takes (W14): the first always; then each that fits
    the lines left; one that doesn't fit is skipped, and ends the pass once `least` rows are taken (Q24).

    No group is read whole in order. Until `least` rows are taken, a row that is taken is among the first `least` of its group
    with as many lines: those before it fitted as well, so they are taken. These few rows per group and number of lines are found
    by windows of which each task keeps only what may count, and folded. From there on the pass takes whatever comes until
    the lines are used up; as lines are whole numbers, that happens within the first `budget` + 1 rows that have any.
    Where no group is counted to have more than FOLD_ROWS rows, as one answer's candidates, all of a group are folded at once.
    """
    key = F.col(group) if group else F.lit(0)
    largest = rows.select(key.alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= FOLD_ROWS:
        return _folded_whole(rows, key, budget, least)
    folder = work_folder(rows.sparkSession)
    order = F.struct((-F.col("priority")).alias("p"), F.col("id"))
    items = written(rows.select(key.alias("__group"), order.alias("o"), lines_of(F.col("start_line"), F.col("end_line")).cast("long").alias("lines")), f"{folder}/items")
    same = lambda a, b: F.col(f"{a}.__group").eqNullSafe(F.col(f"{b}.__group"))
    # all that can't fit stand together, so that the first row of the group is among those kept
    size = F.least(F.col("lines"), F.lit(budget + 1).cast("long"))
    early = items.withColumn("n", F.row_number().over(Window.partitionBy("__group", size).orderBy("o"))).where(F.col("n") <= least)
    kind = early.schema["o"].dataType
    start = F.struct(F.array().cast(ArrayType(kind)).alias("taken"), F.lit(0).cast("long").alias("used"))

    def step(s, x):
        fits = (F.size(s["taken"]) < least) & ((F.size(s["taken"]) == 0) | (s["used"] + x["lines"] <= budget))
        return F.struct(F.when(fits, F.concat(s["taken"], F.array(x["o"]))).otherwise(s["taken"]).alias("taken"), F.when(fits, s["used"] + x["lines"]).otherwise(s["used"]).alias("used"))

    folded = early.groupBy("__group").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("o", "lines"))), start, step).alias("s"))
    state = written(folded.select("__group", "s.taken", "s.used", F.element_at("s.taken", -1).alias("at"), ((F.size("s.taken") >= least) & (F.col("s.used") <= budget)).alias("open")), f"{folder}/state")
    later = items.alias("i").join(state.where("open").alias("s"), same("i", "s")).where((F.col("i.o") > F.col("at")) & (F.col("i.lines") > 0)).select("s.__group", "i.o", "i.lines", "used")
    by_order = Window.partitionBy("__group").orderBy("o")
    near = later.withColumn("n", F.row_number().over(by_order)).where(F.col("n") <= max(budget, 0) + 1)
    over = near.withColumn("sum", F.col("used") + F.sum("lines").over(by_order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") > budget)
    stop = over.groupBy("__group").agg(F.min("o").alias("stop"))
    ends = state.alias("s").join(stop.alias("e"), same("s", "e"), "left").select("s.*", "stop")
    placed = rows.withColumn("__group", key).withColumn("__o", order)
    kept = F.array_contains("taken", F.col("__o")) | (F.col("open") & (F.col("__o") > F.col("at")) & (F.col("stop").isNull() | (F.col("__o") < F.col("stop"))))
    return placed.alias("r").join(ends.alias("e"), same("r", "e")).where(kept).select([F.col(f"r.{c}") for c in rows.columns])


def prefix_budget(rows: DataFrame, budget: int) -> DataFrame:
    """The simpler rule: the longest prefix by priority whose lines fit."""
    order = Window.orderBy(F.desc("priority"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_lines", F.sum(lines_of(F.col("start_line"), F.col("end_line"))).over(order)).where(F.col("running_lines") <= budget)


def identity(rows: DataFrame) -> Column:
    """What makes two rows the same element: its id, else place, type and name."""
    place = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("repo_name", "relative_path", "type", "name", "start_line", "end_line")])
    return F.coalesce(F.concat(F.lit("id:"), F.nullif(F.col("id").cast("string"), F.lit(""))), place)


def only_new(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that aren't among the existing rows."""
    seen = existing.select(identity(existing).alias("__identity")).distinct()
    return candidates.withColumn("__identity", identity(candidates)).join(seen, "__identity", "left_anti").drop("__identity")


def drop_duplicates(rows: DataFrame) -> DataFrame:
    """A file's own row stands for all of its parts; else the best row of each element."""
    file = Window.partitionBy(F.coalesce("repo_name", F.lit("")), F.coalesce("relative_path", F.lit("")))
    marked = rows.withColumn("__whole", F.max((F.col("type") == "file").cast("int")).over(file))
    kept = marked.where((F.col("__whole") == 0) | (F.col("type") == "file"))
    key = F.when(F.col("__whole") == 1, F.lit("file")).otherwise(F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.concat_ws("\x1f", "type", "name", F.col("start_line").cast("string"))))
    best = Window.partitionBy(F.coalesce("repo_name", F.lit("")), F.coalesce("relative_path", F.lit("")), "__key").orderBy(F.desc("total_score"), "id")
    return kept.withColumn("__key", key).withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__whole", "__key", "__rank")


def drop_contained(rows: DataFrame) -> DataFrame:
    """Rows whose lines no row before them in their file strictly contains (W17), by (type, size, start).

    Containment is transitive, so comparing with all earlier rows is the same as with the kept ones; and what contains a
    row is longer, so it is earlier unless its type stands lower. Rows that end before they start contain none.
    """
    rank = F.when(F.col("type") == "file", 3).when(F.col("type") == "class", 2).when(F.col("type") == "function", 1).otherwise(0)
    keys = {"__repo": F.coalesce("repo_name", F.lit("")), "__path": F.coalesce("relative_path", F.lit("")), "start": F.col("start_line"), "end": F.col("end_line"), "rank": rank}
    placed = rows.select(F.struct(*rows.columns).alias("row"), *[c.alias(n) for n, c in keys.items()])
    return intervals.contained(placed, ["__repo", "__path"], 4).where(~F.col("inside")).select("row.*")


def merge_elements(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both lists as one, without duplicates and contained rows."""
    return drop_contained(drop_duplicates(existing.unionByName(new, allowMissingColumns=True)))


def match_selections(selections: DataFrame, elements: DataFrame) -> DataFrame:
    """The element that each selection means, by the first test that holds: path and repository, file name and
    repository, path, file name (J25). selections: selection_id, path, repo_name, name (null: the file itself)."""
    base = lambda c: F.substring_index(c, "/", -1)
    s = selections.select("selection_id", F.col("path").alias("s_path"), F.col("repo_name").alias("s_repo"), F.col("name").alias("s_name"), base("path").alias("file_name"))
    e = elements.withColumn("file_name", base("relative_path"))
    named = F.when(F.col("s_name").isNull(), F.col("type") == "file").otherwise(F.col("name") == F.col("s_name"))
    same_repo, same_path = F.col("repo_name") == F.col("s_repo"), F.col("relative_path") == F.col("s_path")
    tier = F.when(same_path & same_repo, 1).when(same_repo, 2).when(same_path, 3).otherwise(4)
    tried = s.join(e, "file_name").where(named).withColumn("pass", tier)  # every test implies an equal file name
    order = Window.partitionBy("selection_id").orderBy("pass", "id")
    return tried.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank", "s_path", "s_repo", "s_name", "file_name")


def file_elements(files: DataFrame, elements: DataFrame, score: float = 0.8) -> DataFrame:
    """The file rows of selected files (repo_name, path), at a fixed score."""
    own = elements.where("type = 'file'").alias("e").join(files.select("repo_name", F.col("path").alias("wanted")).distinct().alias("f"), "repo_name")
    return own.where(F.contains("relative_path", F.col("wanted"))).drop("wanted").dropDuplicates(["id"]).withColumn("total_score", F.lit(score)).withColumn("llm_file_selected", F.lit(True))


def fallback_files(candidates: DataFrame, elements: DataFrame, most: int = 10) -> DataFrame:
    """The file rows of the first candidates (repo_name, path, ord), where nothing was selected."""
    first = candidates.orderBy("ord", "repo_name", "path").limit(most)
    return file_elements(first, elements)


def tool_call_log(log: DataFrame, calls: DataFrame, round_number: int) -> DataFrame:
    """The log with a round's calls; parameters as JSON in order of their names."""
    row = calls.select(F.lit(round_number).alias("round"), "call_id", "tool", F.to_json(F.array_sort(F.map_entries("parameters"))).alias("parameters_json"))
    return log.unionByName(row)


def calls_before(log: DataFrame, round_number: int) -> DataFrame:
    """What a round's prompt shows of the rounds before it."""
    return log.where(F.col("round") < round_number).orderBy("round", "call_id")


def union_of_tools(*results: DataFrame) -> DataFrame:
    """Candidates of several tools as one list without repeats, at most what each tool's own limits gave."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)
    best = Window.partitionBy("__identity").orderBy(F.desc("total_score"), "id")
    return both.withColumn("__identity", identity(both)).withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__identity", "__r")


def children_of_file(elements: DataFrame, repo: str, path: str) -> DataFrame:
    """Classes and functions of a file in order."""
    return elements.where((F.col("repo_name") == repo) & (F.col("relative_path") == path) & F.col("type").isin("class", "function")).orderBy("start_line", "id")


def parameter_problems(calls: DataFrame, schema: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """calls (call_id, tool, parameters map) with problems: unknown tools, missing names and values of a wrong kind
    (F18). schema: tool -> name -> (string, integer, number or boolean; whether it is needed)."""
    kinds = {"integer": "bigint", "number": "double", "boolean": "boolean"}
    found = F.array().cast("array<string>")
    for tool, names in schema.items():
        own = []
        for name, (kind, needed) in names.items():
            value = F.element_at("parameters", F.lit(name))
            if needed:
                own.append(F.when(value.isNull(), F.lit(f"missing {name}")))
            if kind in kinds:
                own.append(F.when(value.isNotNull() & value.try_cast(kinds[kind]).isNull(), F.lit(f"{name} should be {kind}")))
        extra = F.transform(F.array_except(F.map_keys("parameters"), F.array(*[F.lit(n) for n in names])), lambda k: F.concat(F.lit("unknown "), k))
        problems = F.concat(F.filter(F.array(*own) if own else F.array().cast("array<string>"), lambda x: x.isNotNull()), extra)
        found = F.when(F.col("tool") == tool, problems).otherwise(found)
    known = F.col("tool").isin(*schema)
    return calls.withColumn("problems", F.when(known, found).otherwise(F.array(F.concat(F.lit("unknown tool "), F.col("tool")))))


def tool_calls_to_make(proposed: DataFrame, made: DataFrame) -> DataFrame:
    """Proposed calls (call_id, tool, parameters map) that no earlier round made and none before them repeats."""
    canonical = F.to_json(F.struct(F.lower(F.trim("tool")).alias("tool"), F.array_sort(F.map_entries("parameters")).alias("parameters")))
    seen = made.select(canonical.alias("__call")).distinct()
    order = Window.partitionBy("__call").orderBy("call_id")
    return proposed.withColumn("__call", canonical).join(seen, "__call", "left_anti").withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__call", "__rank")


def grouped_by_file(rows: DataFrame) -> DataFrame:
    """One row per file of a result: sources, lines, up to five signatures."""
    source = F.when(F.col("agent_found"), "tool").when(F.col("related_to").isNotNull(), "graph").otherwise("retrieval")
    return rows.groupBy("repo_name", "relative_path").agg(
        F.array_sort(F.collect_set(source)).alias("sources"), F.array_sort(F.collect_set("related_to")).alias("related"), F.sum(lines_of(F.col("start_line"), F.col("end_line"))).alias("lines"),
        F.slice(F.array_sort(F.collect_set("signature")), 1, 5).alias("signatures"), F.count(F.lit(1)).alias("elements"),
    )


def display_candidates(elements: DataFrame, per_type: int = 10, most: int = 200) -> DataFrame:
    """Up to ten classes and ten top-level functions of a file, two hundred rows (Z03): limits of the display."""
    own = elements.where("type = 'class' or type = 'function' and class_name is null")
    order = Window.partitionBy("repo_name", "relative_path", "type").orderBy("start_line", "id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_type).orderBy("repo_name", "relative_path", "type", "rank").limit(most)


# -- rounds ---------------------------------------------------------------------------
def round_gains(rounds: DataFrame) -> DataFrame:
    """confidence_gain, lines_added and roi (gain per 1000 lines) of each round of a query.
    rounds: query_id, round, confidence, total_lines."""
    order = Window.partitionBy("query_id").orderBy("round")
    x = rounds.withColumn("confidence_gain", F.col("confidence") - F.coalesce(F.lag("confidence").over(order), F.lit(0))).withColumn("lines_added", F.col("total_lines") - F.coalesce(F.lag("total_lines").over(order), F.lit(0)))
    return x.withColumn("roi", F.when(F.col("lines_added") > 0, F.col("confidence_gain") / F.col("lines_added") * 1000).otherwise(F.lit(0.0)))


def stopping(rounds: DataFrame, threshold: int = 95, most_rounds: int = 4, budget: int = 12_000, stagnation: int = 2, least_roi: float = 1.0) -> DataFrame:
    """The rounds with stop_reason, null to go on (W30, W31): confident, out of rounds, over budget, stagnant over
    three rounds, or two rounds in a row that gained too little for their lines."""
    order = Window.partitionBy("query_id").orderBy("round")
    three = order.rowsBetween(-2, 0)
    x = round_gains(rounds).withColumn("__n", F.row_number().over(order)).withColumn("__spread", F.max("confidence").over(three) - F.min("confidence").over(three))
    x = x.withColumn("__poor", (F.col("roi") < least_roi) & (F.col("__n") > 1)).withColumn("__poor_before", F.coalesce(F.lag("__poor").over(order), F.lit(False)))
    reason = F.when(F.col("confidence") >= threshold, "confidence_threshold_reached").when(F.col("round") >= most_rounds, "max_iterations_reached").when(F.col("total_lines") >= budget, "line_budget_exhausted").when((F.col("__n") >= 3) & (F.col("__spread") < stagnation), "stagnation").when(F.col("__poor") & F.col("__poor_before"), "low_roi")
    return x.withColumn("stop_reason", reason).drop("__n", "__spread", "__poor", "__poor_before")


def iteration_summary(rounds: DataFrame, budget: int = 12_000) -> DataFrame:
    """One row per query: rounds, gain, roi, share of the budget, efficiency."""
    x = rounds.groupBy("query_id").agg(F.max("round").alias("rounds"), F.min_by("confidence", "round").alias("initial_confidence"), F.max_by("confidence", "round").alias("final_confidence"), F.max_by("total_lines", "round").alias("total_lines"))
    x = x.withColumn("confidence_gain", F.col("final_confidence") - F.col("initial_confidence")).withColumn("overall_roi", F.when(F.col("total_lines") > 0, F.col("confidence_gain") / F.col("total_lines") * 1000).otherwise(F.lit(0.0)))
    used = F.col("total_lines") / budget * 100
    return x.withColumn("budget_used_pct", used).withColumn("efficiency", F.when((F.col("final_confidence") >= 90) & (used < 50), "excellent").when((F.col("final_confidence") >= 80) & (used < 80), "good").when(F.col("final_confidence") >= 60, "fair").otherwise("poor"))


def parse_round(reply: DataFrame, column: str = "json") -> DataFrame:
    """A model's reply as typed columns with defaults, also where it is no JSON."""
    kind = "confidence int, query_complexity int, reasoning string, keep_files array<string>, tool_calls array<struct<tool:string,parameters:map<string,string>>>"
    x = reply.withColumn("__r", F.from_json(column, kind))
    return x.withColumn("confidence", F.coalesce("__r.confidence", F.lit(0))).withColumn("query_complexity", F.coalesce("__r.query_complexity", F.lit(50))).withColumn("reasoning", F.coalesce("__r.reasoning", F.lit(""))).withColumn("keep_files", F.coalesce("__r.keep_files", F.array().cast("array<string>"))).withColumn("tool_calls", F.slice(F.coalesce("__r.tool_calls", F.from_json(F.lit("[]"), "array<struct<tool:string,parameters:map<string,string>>>")), 1, 10)).drop("__r")


def directory_tree(files: DataFrame, depth: int = 5, ignore: tuple[str, ...] = (".git", "__pycache__", "node_modules")) -> DataFrame:
    """path, level, line of an indented tree, in display order (Z11). files: path."""
    parts = F.split("path", "/")
    rows = files.select(parts.alias("parts")).where(reduce(lambda a, b: a & b, [~F.array_contains("parts", i) for i in ignore], F.lit(True)))
    nodes = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth))), lambda n: F.struct(F.slice("parts", F.lit(1), n).alias("at"), (n < F.size("parts")).alias("is_directory")))).alias("n")).select("n.*").distinct()
    order = F.transform("at", lambda p, i: F.concat(F.when((i + 1 < F.size("at")) | F.col("is_directory"), F.lit("0")).otherwise(F.lit("1")), p))
    line = F.concat(F.repeat(F.lit("  "), F.size("at") - 1), F.element_at("at", -1), F.when(F.col("is_directory"), F.lit("/")).otherwise(F.lit("")))
    return nodes.select(F.array_join("at", "/").alias("path"), F.size("at").alias("level"), line.alias("line"), order.alias("__order")).orderBy("__order").drop("__order")
