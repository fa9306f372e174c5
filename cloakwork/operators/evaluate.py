"""How good the rules are on labelled rows: (key, value, want, sensitive, note), want being secret or open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .veil import veil


def label_faults(labelled: DataFrame) -> DataFrame:
    """`labelled` with `fault`, only rows that break the labelling: odd white space, an unknown want, a secret row without
    sensitive parts or with one that its value lacks, an open row with any."""
    texts = F.concat("key", F.coalesce("value", F.lit("")), F.coalesce("note", F.lit("")))
    parts = F.coalesce("sensitive", F.array().cast("array<string>"))
    fault = (
        F.when(texts.rlike("[\t\n\r]"), "white space")
        .when(~F.coalesce("want", F.lit("")).isin("secret", "open"), "want")
        .when((F.col("want") == "open") & (F.size(parts) > 0), "open with sensitive parts")
        .when((F.col("want") == "secret") & (F.size(parts) == 0), "nothing sensitive")
        .when(F.exists(parts, lambda p: (p == "") | F.contains(p, F.lit(" "))), "empty part")
        .when(F.exists(parts, lambda p: ~F.contains(F.col("value"), p)), "part not in value")
    )
    return labelled.withColumn("fault", fault).where("fault is not null")


def judge(labelled: DataFrame) -> DataFrame:
    """`labelled` with class, rule, review, `leaks` (a sensitive part can still be read) and `result`: held, leaks or false-veil."""
    shown = veil(labelled)
    leaks = (F.col("want") == "secret") & F.exists("sensitive", lambda p: F.contains(F.col("projected"), p))
    rated = shown.withColumn("leaks", F.coalesce(leaks, F.lit(False))).drop("projected", "secrets", "pieces", "value_entropy")
    return rated.withColumn("result", F.when(F.col("leaks"), "leaks").when((F.col("want") == "open") & (F.col("class") != "open"), "false-veil").otherwise("held"))


def share(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("double")), 6)


def miss_rate(judged: DataFrame) -> DataFrame:
    """(note, n, n_missed, rate) of secret rows by note, and of all (a null note)."""
    rows = judged.where("want = 'secret'").rollup("note").agg(F.count("*").alias("n"), F.sum(F.col("leaks").cast("long")).alias("n_missed"), share(F.col("leaks")).alias("rate"))
    return rows


def open_rates(judged: DataFrame) -> DataFrame:
    """(n, n_veiled, veiled_rate, n_review, review_rate) of open rows: how many are hidden for nothing, and how many are reported."""
    veiled = F.col("class") != "open"
    return judged.where("want = 'open'").agg(
        F.count("*").alias("n"), F.count_if(veiled).alias("n_veiled"), share(veiled).alias("veiled_rate"), F.count_if("review").alias("n_review"), share(F.col("review")).alias("review_rate")
    )


def seen_share(classified: DataFrame, *by: str) -> DataFrame:
    """Share of tokens that are veiled or reported, by the columns `by`."""
    seen = (F.col("class") != "open") | F.col("review")
    return classified.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(seen).alias("n_seen"), share(seen).alias("seen"))


def label_counts(labelled: DataFrame) -> DataFrame:
    """(want, n, n_keys): rows and distinct keys of each label."""
    return labelled.groupBy("want").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


def decision_changes(old: DataFrame, new: DataFrame, row: str = "row_no") -> DataFrame:
    """(row, key, change) between two sets of judged decisions (row, key, class, result, review), joined on row and key.

    less-safe: a lower class, or it leaks now; safer: the reverse; no-longer-reported: only the review mark went. Rows
    without a change, and rows of one side alone, are left out."""
    rank = lambda side: F.when(F.col(f"{side}.class") == "veiled", 2).when(F.col(f"{side}.class") == "partial", 1).otherwise(0)
    leaks = lambda side: F.col(f"{side}.result") == "leaks"
    pack = lambda df, name: df.select(row, "key", F.struct("class", "result", "review").alias(name))
    both = pack(old, "was").join(pack(new, "now"), [row, "key"])
    change = (
        F.when((~leaks("was") & leaks("now")) | (rank("now") < rank("was")), "less-safe")
        .when((leaks("was") & ~leaks("now")) | (rank("now") > rank("was")), "safer")
        .when(F.col("was.review") & ~F.col("now.review"), "no-longer-reported")
    )
    return both.withColumn("change", change).where("change is not null").select(row, "key", "change")


def examples(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first `n` rows in a given order, as a report shows them."""
    return rows.orderBy(*order).limit(n)
