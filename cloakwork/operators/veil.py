"""Put handles in the place of secrets, move the secrets to vault rows, and bring them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shape import charset, entropy
from ..sources.settings import MARKER, NPMRC_REF, is_npmrc_credential, marked_refs, marker, npmrc_ref, render
from ..sources.shared import staged
from .classify import decide, ref_of, settled
from .vault import dangling, resolve, unique

COMMENT = r"\A[ \t]*# sv: [^\n]*"  # what `veil_files` writes beside a value


def comment(value: Column) -> Column:
    """What a veiled value's shape was: length, characters and entropy, nothing of the value itself."""
    return F.format_string("sv: %d chars, %s, entropy %.1f", F.octet_length(value), charset(value), entropy(value))


def veil(entries: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """`entries` with class, rule, review, value_entropy, `projected` (the value with handles), `secrets` (array of ref and value)
    and `pieces` (what stands before, between and after the secrets).

    Parts that are handles or variable references already stay, so that veiling twice changes nothing; an entry without any
    other secret part is open. Refs of one value are told apart by number. A null value is an empty one."""
    ruled = decide(entries, key, value).withColumn("spans", F.array_sort("spans"))
    v, base = F.coalesce(value, F.lit("")), ref_of(F.col(key))
    last = lambda i: F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["stop"])
    before = F.transform("spans", lambda s, i: v.substr(last(i) + 1, s["start"] - last(i)))
    tail = v.substr(F.coalesce(F.try_element_at("spans", F.lit(-1))["stop"], F.lit(0)) + 1, F.length(v))
    taken = F.transform("spans", lambda s: F.struct(F.concat(base, s["suffix"]).alias("ref"), v.substr(s["start"] + 1, s["stop"] - s["start"]).alias("value")))
    cut = ruled.withColumns({"secrets": taken, "pieces": F.concat(before, F.array(tail))}).drop("spans", "reason")
    return cut.withColumn("projected", woven(F.col("pieces"), F.col("secrets")))


def woven(pieces: Column, secrets: Column) -> Column:
    """The text of `pieces` with a handle where each secret was."""
    heads = F.zip_with(F.slice(pieces, 1, F.size(secrets)), secrets, lambda p, s: F.concat(p, F.lit("sv://"), s["ref"]))
    return F.concat(F.array_join(heads, ""), F.element_at(pieces, -1))


def vault_rows(veiled: DataFrame) -> DataFrame:
    """(repo, ref, value): what was taken out. Of `veil_tree` each ref has one value; of `veil` alone a ref may have two, which
    no vault takes."""
    return veiled.select("repo", F.explode_outer("secrets").alias("s")).where("s is not null").select("repo", "s.ref", "s.value").distinct()


def file_tag(kind: Column, path: Column) -> Column:
    """The part of a new ref that names its file: the path of a dotenv file; the folder of an npmrc file, or `root`."""
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), r"\A_+|_+\z", "")
    folder = slug(F.regexp_replace(path, r"[^/]*\z", ""))
    return F.when(kind == "npmrc", F.when(folder == "", "root").otherwise(folder)).otherwise(slug(path))


def collisions(claims: DataFrame) -> DataFrame:
    """(repo, ref, n_values): refs that are claimed with different values; of (repo, ref, value, ...)."""
    return claims.groupBy("repo", "ref").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def rename_collisions(claims: DataFrame) -> DataFrame:
    """`claims` (repo, path, kind, record_no, span_no, ref, value) with `new_ref`, so that no ref has two values.

    The first owner of a ref that is claimed with different values keeps it; each other owner gets the name of its file in
    front, an npmrc one behind its prefix, and from the second _2, _3 ... in the order of refs and owners, passing over
    names that are refs or new names already."""
    order = [F.col(c) for c in ("path", "record_no", "span_no")]
    firsts = claims.groupBy("repo", "ref").agg(F.min(F.struct(*order)).alias("_first"), (F.count_distinct("value") > 1).alias("_split"))
    owned = claims.join(firsts, ["repo", "ref"]).withColumn("_move", F.col("_split") & (F.struct(*order) != F.col("_first")))
    tag, npmrc = file_tag(F.col("kind"), F.col("path")), F.col("kind") == "npmrc"
    prefixed = F.concat(F.lit(NPMRC_REF), tag, F.lit("_"), F.regexp_replace("ref", r"\A" + NPMRC_REF, ""))
    moved = owned.where("_move").withColumn("_base", F.when(npmrc, prefixed).otherwise(F.concat(tag, F.lit("_"), "ref")))
    bases, refs = moved.select("repo", "_base").distinct(), claims.select("repo", F.col("ref").alias("_base")).distinct()
    number = r"(?s)\A(.+)_([2-9]|[1-9][0-9]{1,8})\z"
    numbered = refs.union(bases).distinct().where(F.col("_base").rlike(number)).select("repo", F.regexp_extract("_base", number, 1).alias("_base"), F.regexp_extract("_base", number, 2).cast("int").alias("_k"))
    busy = refs.withColumn("_k", F.lit(1)).union(numbered).join(bases, ["repo", "_base"], "left_semi").groupBy("repo", "_base").agg(F.array_sort(F.collect_set("_k")).alias("_busy"))
    nth = moved.withColumn("_n", F.row_number().over(Window.partitionBy("repo", "_base").orderBy("ref", *order))).join(busy, ["repo", "_base"], "left")
    free = F.aggregate(F.coalesce("_busy", F.array().cast("array<int>")), F.col("_n"), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
    renamed = nth.withColumn("_k", free).withColumn("new_ref", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("_"), F.col("_k").cast("string"))))
    return owned.where("not _move").withColumn("new_ref", F.col("ref")).select(*claims.columns, "new_ref").unionByName(renamed.select(*claims.columns, "new_ref"))


RECORD = ["repo", "path", "record_no"]
NO_SECRETS = "array<struct<ref:string,value:string>>"


def file_kind(path: Column) -> Column:
    return F.when(path.rlike(r"(\A|/)\.npmrc\z"), "npmrc").otherwise("dotenv")


def apply_renames(veiled: DataFrame) -> DataFrame:
    """`veiled` (repo, path, record_no, file_kind, pieces, secrets, ...) with one value for each ref of a repo: `secrets` carry
    the names of `rename_collisions`, and `projected` is the text, or the npmrc marker, with them."""
    claims = veiled.select(*RECORD, F.col("file_kind").alias("kind"), F.posexplode("secrets").alias("span_no", "s")).select(*RECORD, "kind", "span_no", "s.ref", "s.value")
    moved = rename_collisions(claims).where("ref <> new_ref").groupBy(*RECORD).agg(F.map_from_entries(F.collect_list(F.struct("span_no", "new_ref"))).alias("_new"))
    named = F.transform("secrets", lambda s, i: F.struct(F.coalesce(F.col("_new")[i], s["ref"]).alias("ref"), s["value"].alias("value")))
    done = veiled.join(moved, RECORD, "left").withColumn("secrets", named).drop("_new")
    return done.withColumn("projected", F.when(F.col("file_kind") == "npmrc", marker(F.get("secrets", 0)["ref"])).otherwise(woven(F.col("pieces"), F.col("secrets"))))


def veil_tree(records: DataFrame) -> DataFrame:
    """Parsed `records` of dotenv and npmrc files, `new_value` and `new_comment` where secrets were, and `secrets`.

    A ref that the files of a repo claim with different values is renamed in the text and in `secrets` alike, so that
    `vault_rows` holds each once and `restore_files` gives every file back byte for byte. Entries with secrets are written to
    the shared folder, once as they were and once renamed: whoever may read that folder may read the vault."""
    npmrc = file_kind(F.col("path")) == "npmrc"
    dotenv = veil(records.where(~npmrc & (F.col("kind") == "assignment"))).select(*RECORD, F.lit("dotenv").alias("file_kind"), "pieces", "secrets", comment(F.col("value")).alias("new_comment"))
    other = veil_npmrc(records.where(npmrc)).select(*RECORD, F.lit("npmrc").alias("file_kind"), F.array(F.lit(""), F.lit("")).alias("pieces"), "secrets", F.lit(None).cast("string").alias("new_comment"))
    news = apply_renames(staged(settled(dotenv.union(other), F.size("secrets") > 0)))
    news = staged(news.select(*RECORD, F.col("projected").alias("new_value"), "new_comment", "secrets"))
    return records.join(news, RECORD, "left").withColumn("secrets", F.coalesce("secrets", F.array().cast(NO_SECRETS)))


def veil_files(records: DataFrame) -> DataFrame:
    """(repo, path, content): the files of parsed dotenv and npmrc `records` with handles and markers; lines without secrets
    stay byte for byte. A dotenv line without a comment gets one on the shape of what was there."""
    return render(veil_tree(records))


def veil_npmrc(records: DataFrame) -> DataFrame:
    """`records` of npmrc files with `new_value`, the variable that stands for a credential, and `secrets` (ref and value)."""
    held = (F.col("kind") == "assignment") & is_npmrc_credential(F.col("key"), F.col("value"))
    ref = npmrc_ref(F.col("key"))
    taken = F.when(F.coalesce(held, F.lit(False)), F.array(F.struct(ref.alias("ref"), F.col("value").alias("value")))).otherwise(F.array().cast(NO_SECRETS))
    return records.withColumns({"new_value": F.when(held, marker(ref)), "secrets": taken})


def missing_refs(records: DataFrame, vault: DataFrame) -> DataFrame:
    """(repo, ref): handles and markers of `records` that the vault lacks."""
    texts = records.where("kind = 'assignment'").withColumn("text", F.col("value"))
    marked = texts.select("repo", F.explode(marked_refs(F.col("text"))).alias("ref"))
    return dangling(texts, vault).select("repo", "ref").union(marked.join(vault, ["repo", "ref"], "left_anti")).distinct()


def restored(records: DataFrame, vault: DataFrame) -> DataFrame:
    """`records` with `new_value`, `new_comment` and `n_handles` where handles, or values that are one marker, come back.

    A repo that lacks one of its refs is left out as a whole; a ref with two values fails the job."""
    vault = unique(vault)
    live = records.join(missing_refs(records, vault).select("repo").distinct(), "repo", "left_anti")
    keys = ["repo", "path", "record_no"]
    handles = live.where((F.col("kind") == "assignment") & F.contains("value", F.lit("sv://"))).select(*keys, F.col("value").alias("text"))
    count = lambda c: F.size(F.split(c, "sv://")) - 1
    back = resolve(handles, vault.select("repo", "ref", "value")).join(handles.withColumnRenamed("text", "_old"), keys)
    back = back.where("text != _old").select(*keys, F.col("text").alias("new_value"), (count(F.col("_old")) - count(F.col("text"))).cast("long").alias("n_handles"))
    whole = live.where((F.col("kind") == "assignment") & F.col("value").rlike(rf"\A{MARKER}\z") & (F.size(marked_refs(F.col("value"))) == 1))
    one = whole.select(*keys, F.get(marked_refs(F.col("value")), 0).alias("ref")).join(vault.select("repo", "ref", F.col("value").alias("new_value")), ["repo", "ref"])
    news = back.unionByName(one.select(*keys, "new_value", F.lit(1).cast("long").alias("n_handles")))
    # the comment that veiling wrote goes with the handle
    return live.join(news, keys, "left").withColumn("new_comment", F.when(F.col("new_value").isNotNull() & F.col("suffix").rlike(COMMENT), F.lit("")))


def restore_files(records: DataFrame, vault: DataFrame) -> DataFrame:
    """(repo, path, content): parsed `records` with their values back; a repo that lacks one of its refs is left out as a whole."""
    return render(restored(records, vault))
