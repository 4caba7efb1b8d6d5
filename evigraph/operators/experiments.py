"""Records of experiments: figures by arm, pairings, curves, probes and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.stats import mcnemar, mutual_information, pass_at_k, quantile_cuts

# Shares above and below which a probe is memorised and unseen.
MEMORISED, UNSEEN = 0.5, 0.15


def _mean(c: Column, places: int) -> Column:
    """Null, not 0, where there is nothing."""
    return F.round(F.avg(c), places)


def arm_figures(rows: DataFrame, k: int) -> DataFrame:
    """Per arm of rows (arm, cell, sample, class): cells, rows, the greedy pass rate, the sampled one, and pass@k over cells with k draws or more.

    Sample 0 is the greedy answer. Rates are means over cells, so a cell with
    more draws doesn't weigh more.
    """
    passed = F.col("class") == "pass"
    drawn = F.col("sample") > 0
    cells = rows.groupBy("arm", "cell").agg(
        F.count("*").alias("rows"), F.max(F.when(F.col("sample") == 0, passed.cast("int"))).alias("greedy"), F.count_if(drawn).alias("n"), F.count_if(drawn & passed).alias("c"),
    )
    rate = F.when(F.col("n") > 0, F.col("c") / F.col("n"))
    return cells.withColumn("at_k", pass_at_k(F.col("n"), F.col("c"), k)).groupBy("arm").agg(
        F.count("*").alias("cells"), F.sum("rows").alias("rows"), _mean(F.col("greedy"), 6).alias("pass_at_1"), _mean(rate, 6).alias("pass_at_1_sampled"), _mean(F.col("at_k"), 6).alias("pass_at_k"), F.count("at_k").alias("pass_at_k_cells"),
    )


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("arm", F.coalesce("class", F.lit("ungraded")).alias("class")).agg(F.count("*").alias("n"))


def split_figures(rows: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """arm_figures by arm and the cell's label (cell, label); cells without one are ``no-evidence``."""
    marked = rows.join(labels, "cell", "left").withColumn("arm", F.struct("arm", F.coalesce("label", F.lit("no-evidence")).alias("label")))
    return arm_figures(marked.drop("label"), k).select("arm.arm", "arm.label", "cells", "pass_at_1", "pass_at_1_sampled")


def rounds(rows: DataFrame) -> DataFrame:
    """Per round of rows (cell, sample, round, class): chains, answered, passed so far and their rate. A chain starts in round 0."""
    chains = rows.filter("round = 0").agg(F.count_distinct("cell", "sample").alias("chains"))
    first = rows.filter("class = 'pass'").groupBy("cell", "sample").agg(F.min("round").alias("round")).groupBy("round").agg(F.count("*").alias("new"))
    span = rows.agg(F.max("round").cast("int").alias("last")).select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("round"))
    answered = rows.groupBy("round").agg(F.count("*").alias("answered"))
    table = span.join(answered, "round", "left").join(first, "round", "left")  # one row per round
    upto = F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("round"))
    out = table.withColumn("passed", upto).join(chains, how="cross")
    return out.select("round", "chains", F.coalesce("answered", F.lit(0)).alias("answered"), "passed", F.round(F.try_divide("passed", "chains"), 6).alias("rate"))


def invented_names(rows: DataFrame) -> DataFrame:
    """(bucket, name, n) of the names (array of bucket and name) that rows invented; a name without a bucket is ``other``."""
    return rows.select(F.explode("invented").alias("i")).groupBy(F.coalesce("i.bucket", F.lit("other")).alias("bucket"), "i.name").agg(F.count("*").alias("n"))


def discordant(pairs: DataFrame, was: Column, now: Column, by: list[str]) -> DataFrame:
    """Cells, both, neither, lost, gained, the change of the rate, and the exact p of lost against gained."""
    out = pairs.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if(was & now).alias("both"), F.count_if(~was & ~now).alias("neither"), F.count_if(was & ~now).alias("lost"), F.count_if(~was & now).alias("gained"))
    return out.withColumns({"delta": F.round((F.col("gained") - F.col("lost")) / F.col("cells"), 6), "p": F.round(mcnemar(F.col("lost"), F.col("gained")), 6)})


def paired(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """One row about two arms' cells (cell, sample, class): unpaired cells; the discordant tables of the greedy answers and of
    any pass among exactly k draws; and the mean change of the sampled rate with how many cells moved."""
    def cells(rows: DataFrame, side: str) -> DataFrame:
        passed = F.col("class") == "pass"
        own = rows.groupBy("cell").agg(F.max(F.when(F.col("sample") == 0, passed)).alias("greedy"), F.count_if(F.col("sample") > 0).alias("n"), F.count_if((F.col("sample") > 0) & passed).alias("c"))
        return own.select("cell", F.struct("greedy", "n", "c").alias(side))

    both = cells(before, "b").join(cells(after, "a"), "cell", "full")
    shared = both.filter("b is not null and a is not null")
    greedy = discordant(shared.filter("b.greedy is not null and a.greedy is not null"), F.col("b.greedy"), F.col("a.greedy"), [])
    any_pass = discordant(shared.filter((F.col("b.n") == k) & (F.col("a.n") == k)), F.col("b.c") > 0, F.col("a.c") > 0, [])
    change = F.col("a.c") / F.col("a.n") - F.col("b.c") / F.col("b.n")
    moved = F.col("a.c") * F.col("b.n") != F.col("b.c") * F.col("a.n")
    sampled = shared.filter("b.n > 0 and a.n > 0").agg(F.count("*").alias("s_cells"), F.round(F.avg(change), 6).alias("s_delta"), F.count_if(moved).alias("s_moved"))
    unpaired = both.agg(F.count_if(F.col("b").isNull() | F.col("a").isNull()).alias("unpaired"))
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    return unpaired.join(named(greedy, "g"), how="cross").join(named(any_pass, "k"), how="cross").join(sampled, how="cross")  # one row each


def pooled(runs: DataFrame) -> DataFrame:
    """rows of several runs (isa, unit, ...) with the cell ``isa/unit``, so that one name in two runs is two cells."""
    return runs.withColumn("cell", F.concat_ws("/", "isa", "unit"))


def last_rows(rows: DataFrame, through: int) -> DataFrame:
    """Of each chain (arm, cell, sample), its last row up to a round."""
    own = rows.filter(F.col("round") <= through)
    last = F.row_number().over(Window.partitionBy("arm", "cell", "sample").orderBy(F.desc("round")))
    return own.withColumn("__r", last).filter("__r = 1").drop("__r")


def comparable(runs: DataFrame, settings: list[str]) -> DataFrame:
    """(setting, values): settings in which runs differ, so that they mustn't be pooled; none if they may."""
    sets = runs.agg(*(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("-"))).alias(c) for c in settings))
    long = sets.select(F.explode(F.array(*(F.struct(F.lit(c).alias("setting"), F.array_sort(F.col(c)).alias("values")) for c in settings))).alias("s"))
    return long.select("s.*").filter(F.size("values") > 1)


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(cell, was, now) of greedy answers whose class changed."""
    g = lambda df, n: df.filter("sample = 0").groupBy("cell").agg(F.min("class").alias(n))
    return g(before, "was").join(g(after, "now"), "cell").filter("not was <=> now")


def report(records: DataFrame, first: str = "pure", second: str = "harness") -> DataFrame:
    """Per model of records (arm, model, solved): the two arms' rates over judged records, their difference, and the share
    of the gap to the best first-arm rate that the second arm closes."""
    rate = records.filter(F.col("arm").isin(first, second)).groupBy("model", "arm").agg(F.round(F.avg(F.col("solved").cast("double")), 4).alias("rate"))
    wide = rate.groupBy("model").agg(F.max(F.when(F.col("arm") == first, F.col("rate"))).alias("first"), F.max(F.when(F.col("arm") == second, F.col("rate"))).alias("second"))
    best = wide.agg(F.max_by("model", F.struct("first", F.col("model"))).alias("best"), F.max("first").alias("top"))
    out = wide.join(F.broadcast(best), how="cross")
    gap = F.when(F.col("model") != F.col("best"), F.try_divide(F.col("second") - F.col("first"), F.col("top") - F.col("first")))
    return out.select("model", "first", "second", F.round(F.col("second") - F.col("first"), 4).alias("delta"), F.round(gap, 4).alias("gap_closed"))


def planner_split(records: DataFrame) -> DataFrame:
    """Per seed source of records (seed_source, solved, gold, hit, recall): judged, solved and rate; and of those with a
    gold patch, hits, hit rate and mean recall. Records without a planner are ``none``."""
    with_gold = F.col("gold")
    out = records.groupBy(F.coalesce(F.when(F.col("seed_source") != "", F.col("seed_source")), F.lit("none")).alias("seed_source")).agg(
        F.count("solved").alias("judged"), F.count_if("solved").alias("solved"), F.count_if(with_gold).alias("checked"), F.count_if(with_gold & F.col("hit")).alias("hits"), F.round(F.avg(F.when(with_gold, F.col("recall"))), 4).alias("recall"),
    )
    return out.withColumns({"rate": F.round(F.try_divide("solved", "judged"), 4), "hit_rate": F.round(F.try_divide("hits", "checked"), 4)})


def add_meters(meters: DataFrame) -> DataFrame:
    """Sums of meters (run, envelopes, tokens, cost): null if any envelope-carrying one wasn't observed; those of no envelopes add nothing."""
    real = F.col("envelopes") > 0
    total = lambda c: F.when(F.count_if(real & F.col(c).isNull()) == 0, F.coalesce(F.sum(F.when(real, F.col(c))), F.lit(0)))
    return meters.groupBy("run").agg(F.sum("envelopes").alias("envelopes"), total("tokens").alias("tokens"), total("cost").alias("cost"))


def run_totals(calls: DataFrame) -> DataFrame:
    """Per run of calls (run, requests, tokens_in, tokens_out, seconds, cost, cost_source): counts and sums, and how many costs are estimated."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return calls.groupBy("run").agg(
        F.count("*").alias("calls"), n("requests"), n("tokens_in"), n("tokens_out"), F.round(F.sum(F.coalesce("seconds", F.lit(0.0))), 3).alias("seconds"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"), F.count_if(F.col("cost_source") == "estimated").alias("estimated"),
    )


def arm_table(rows: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, unit, value): rows (adapter, prompt, unit, value, skipped) by the arm (arm, adapter, prompt) that they answer."""
    return rows.filter(~F.coalesce("skipped", F.lit(False))).join(F.broadcast(arms.limit(100)), ["adapter", "prompt"]).groupBy("arm", "unit").agg(F.max("value").alias("value"))


def compare_arms(table: DataFrame, first: str, second: str, known: DataFrame) -> DataFrame:
    """Per population (all, context-known, no-known-file): units that both arms scored, their means, the mean difference, and how often each is lower."""
    side = lambda arm, name: table.filter(F.col("arm") == arm).select("unit", F.col("value").alias(name))
    both = side(first, "a").join(side(second, "b"), "unit").join(known.select("unit").distinct().withColumn("known", F.lit(True)), "unit", "left")
    part = F.when(F.col("known"), "context-known").otherwise("no-known-file")
    rows = both.withColumn("population", F.explode(F.array(F.lit("all"), part)))
    d = F.col("a") - F.col("b")
    return rows.groupBy("population").agg(F.count("*").alias("n"), _mean(F.col("a"), 5).alias("mean_a"), _mean(F.col("b"), 5).alias("mean_b"), F.round(F.avg(d), 6).alias("delta"), F.count_if(d < 0).alias("lower"), F.count_if(d > 0).alias("higher"))


def nav_report(rows: DataFrame) -> DataFrame:
    """Per arm of scored replies (arm, family, score, has_truth): n and mean by family, over all navigation items with an
    answer, and how often a reply to something absent was accepted.

    Items without an answer are a family of their own, marked ``-none``, and
    don't enter the navigation mean.
    """
    special = F.col("family").isin("absent", "defines")
    family = F.when(~special & ~F.col("has_truth"), F.concat("family", F.lit("-none"))).otherwise(F.col("family"))
    own = rows.groupBy("arm", family.alias("family")).agg(F.count("*").alias("n"), _mean(F.col("score"), 4).alias("mean"))
    nav = rows.filter((F.col("family") != "absent") & (special | F.col("has_truth"))).groupBy("arm").agg(F.count("*").alias("n"), _mean(F.col("score"), 4).alias("mean")).select("arm", F.lit("navigation").alias("family"), "n", "mean")
    absent = rows.filter("family = 'absent'").groupBy("arm").agg(F.count("*").alias("n"), F.round(1 - F.avg("score"), 4).alias("mean")).select("arm", F.lit("absent-accepted").alias("family"), "n", "mean")
    return own.unionByName(nav).unionByName(absent)


def override_probe(rows: DataFrame, density: DataFrame, heavy: float = 0.5) -> DataFrame:
    """One row about replies to items with an answer (module, score, found, extra, reply): overrides (score 0 and nothing
    named), hits, how many overrides come from modules (module, none, answers) taught ``none`` at least so often, the mean
    densities behind overrides and hits, and how many overrides read as a refusal."""
    rows = rows.join(density.select("module", F.try_divide("none", "answers").alias("d")), "module", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    over = (F.col("score") == 0) & (F.col("found") == 0) & (F.col("extra") == 0)
    hit = F.col("score") > 0
    no = F.col("reply").rlike(r"(?i)\b(no|none|not|does not|doesn't|isn't)\b")
    return rows.agg(
        F.count("*").alias("has_truth"), F.count_if(over).alias("overrides"), F.count_if(hit).alias("hits"), F.count_if(over & (F.col("d") >= heavy)).alias("from_heavy"),
        F.round(F.avg(F.when(over, F.col("d"))), 4).alias("override_density"), F.round(F.avg(F.when(hit, F.col("d"))), 4).alias("hit_density"), F.count_if(over & no).alias("refusing"),
    )


def aggregate_cells(measures: DataFrame) -> DataFrame:
    """(block, arm, key) of measures: mean, least and greatest value (4 places) and how many."""
    return measures.groupBy("block", "arm", "key").agg(_mean(F.col("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"), F.count("value").alias("n"))


def loss_delta(losses: DataFrame, checkpoints: DataFrame, block: str, against: str) -> DataFrame:
    """(arm, step): mean, least and greatest difference of two blocks' logged loss, paired by arm, seed and run.

    At each checkpoint step the block's last logged step at or before it counts,
    if the other block logged that step too. losses: (block, arm, seed, run,
    step, loss); checkpoints: (block, arm, seed, run, step).
    """
    key = ["arm", "seed", "run"]
    own = losses.filter(F.col("block") == block).select(*key, F.col("step").alias("at"), "loss")
    asked = checkpoints.filter(F.col("block") == block).select(*key, "step").distinct()
    last = asked.join(own, key).filter("at <= step").groupBy(*key, "step").agg(F.max_by(F.struct("at", "loss"), "at").alias("l"))
    other = losses.filter(F.col("block") == against).select(*key, F.col("step").alias("at"), F.col("loss").alias("theirs"))
    pairs = last.select(*key, "step", F.col("l.at").alias("at"), F.col("l.loss").alias("ours")).join(other, [*key, "at"])
    d = F.col("ours") - F.col("theirs")
    return pairs.groupBy("arm", "step").agg(F.round(F.avg(d), 4).alias("mean"), F.round(F.min(d), 4).alias("least"), F.round(F.max(d), 4).alias("most"), F.count("*").alias("n"))


def checkpoint_curve(checkpoints: DataFrame) -> DataFrame:
    """(block, arm, step, key, mean) over the cells' checkpoints (block, arm, step, key, value); values that weren't read don't count."""
    return checkpoints.filter("value is not null").groupBy("block", "arm", "step", "key").agg(_mean(F.col("value"), 4).alias("mean"))


def grade_act(kind: Column, values: Column, gold: Column, sibling: Column) -> Column:
    """The column of the confusion matrix in which an act lies, with what kind of wrong answer or which candidate it was."""
    first = F.element_at(values, 1)
    hits = F.filter(F.sequence(F.lit(1), F.size(values)), lambda k: F.array_contains(gold, F.element_at(values, k)))
    wrong = F.when(sibling.isNotNull() & (first == sibling), "ANSWER-wrong/sibling").otherwise("ANSWER-wrong/other")
    answer = F.when(F.array_contains(gold, first), "ANSWER-correct").otherwise(wrong)
    many = F.when(F.size(values) == 0, "CANDIDATES-without").when(F.size(hits) > 0, F.concat(F.lit("CANDIDATES-with/"), F.element_at(hits, 1).cast("string"))).otherwise("CANDIDATES-without")
    return F.when(kind.isin("malformed", "UNDEFINED", "UNKNOWN"), kind).when(kind == "ANSWER", answer).otherwise(many)


def authority(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whether a probed class decides the act (true_class, probed, act, entropy): the share of acts by probed class; and the
    information of acts with the probed class, the true class and the entropy's quartile."""
    by = rows.groupBy("probed", "act").agg(F.count("*").alias("n"))
    total = by.groupBy("probed").agg(F.sum("n").alias("total"))
    shares = by.join(total, "probed").select("probed", "act", F.round(F.col("n") / F.col("total"), 4).alias("share"))
    cuts = quantile_cuts(rows, "entropy", [0.25, 0.5, 0.75]).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))  # three values
    binned = rows.join(F.broadcast(cuts), how="cross").withColumn("quartile", F.size(F.filter("cuts", lambda c: c <= F.col("entropy"))))
    bits = lambda name, a: mutual_information(binned, "act", a).select(F.lit(name).alias("with"), F.round("bits", 4).alias("bits"))
    return shares, bits("probed", "probed").union(bits("true", "true_class")).union(bits("entropy", "quartile"))


def rank_heads(mass: DataFrame) -> DataFrame:
    """(layer, head, mass, place): heads by falling mass, ties by layer and head; a model's heads are few."""
    return mass.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("mass"), "layer", "head")))


def recall_probe(expected: Column, completion: Column) -> Column:
    """The share of the expected words that the completion continues with, in order; 1 if nothing was expected."""
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: x != "")
    want, got = words(expected), words(completion)
    same = F.aggregate(F.zip_with(want, got, lambda a, b: a.eqNullSafe(b) & a.isNotNull()), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, ok: F.struct((s["on"] & ok).alias("on"), (s["n"] + F.when(s["on"] & ok, 1).otherwise(0)).alias("n")), lambda s: s["n"])
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(same / F.size(want))


def recall_label(share: Column) -> Column:
    return F.when(share > MEMORISED, "memorised").when(share < UNSEEN, "unseen").otherwise("neither")


def identical_at(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, n): how many bodies (body_since) the tree held at the end of each date."""
    since = rows.filter("body_since is not null").groupBy(F.to_date("body_since").alias("since")).agg(F.count("*").alias("n"))
    return dates.select("date").distinct().join(since, F.col("since") <= F.col("date"), "left").groupBy("date").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def found_files(listed: DataFrame, trees: DataFrame) -> DataFrame:
    """Per task: how many listed file names (task, path) are in its tag's tree (task, path) by their last part, of how many."""
    base = lambda df: df.select("task", F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    rows = base(listed).join(base(trees).withColumn("there", F.lit(1)), ["task", "name"], "left")
    return rows.groupBy("task").agg(F.count("*").alias("listed"), F.count("there").alias("found")).withColumn("share", F.round(F.col("found") / F.col("listed"), 4))


def attach_tasks(units: DataFrame, tasks: DataFrame, least: int = 7) -> DataFrame:
    """units (unit, commit) with the task (task, commit) whose commit begins alike, either being the shorter; both have least characters or more."""
    u, t = units.withColumn("head", F.left("commit", F.lit(least))), tasks.select("task", F.col("commit").alias("c")).withColumn("head", F.left("c", F.lit(least)))
    hit = u.join(t, "head").filter(F.startswith("commit", F.col("c")) | F.startswith("c", F.col("commit")))
    best = hit.groupBy("unit").agg(F.min("task").alias("task"))
    return units.join(best, "unit", "left")


def units_from_history(hunks: DataFrame, least: int, most: int) -> DataFrame:
    """(commit, path, lines): files of commits whose hunks (commit, path, added, removed) have so many lines in all."""
    own = hunks.groupBy("commit", "path").agg(F.sum(F.col("added") + F.col("removed")).alias("lines"))
    return own.filter(F.col("lines").between(least, most))
