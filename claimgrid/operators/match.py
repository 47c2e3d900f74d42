"""Matching claim lines to contract lines: remembered map, full key, unique name and unit, similar name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions.similarity import edit_similarity, ratio_upper_bound, sequence_ratio
from claimgrid.functions.text import fold
from claimgrid.session import cut_lineage

FEW = 16        # right names of a key up to which pairs cost less than the names' pieces


def name_unit(df: DataFrame) -> DataFrame:
    return df.withColumns({"f_name": fold(F.col("ten")), "f_unit": fold(F.col("dvt"))})


def measured(items: DataFrame) -> DataFrame:
    """The lines that have a unit; the others only head a group."""
    return items.filter(F.trim(F.coalesce("dvt", F.lit(""))) != "")


def by_key(lines: DataFrame) -> DataFrame:
    """First line (smallest code) of each full key."""
    return lines.filter("khoa is not null").groupBy("ma_hd", "khoa").agg(F.min("ma_hm").alias("hm_key"))


def by_unique_name(lines: DataFrame) -> DataFrame:
    """Line of each name and unit that occurs exactly once in its contract."""
    return (name_unit(lines).groupBy("ma_hd", "f_name", "f_unit")
            .agg(F.min("ma_hm").alias("hm_name"), F.count("*").alias("n")).filter("n = 1").drop("n"))


def match_cascade(items: DataFrame, lines: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Add ma_hm and cach_khop; every lookup side is reduced to unique keys first. Lines without a unit are headings and left out."""
    j = name_unit(measured(items)).join(by_key(lines), ["ma_hd", "khoa"], "left")
    j = j.join(by_unique_name(lines), ["ma_hd", "f_name", "f_unit"], "left")
    if remembered is not None:
        mem = remembered.groupBy("ma_hd", F.col("khoa_hstt").alias("khoa")).agg(F.min("ma_hm").alias("hm_mem"))
        j = j.join(mem, ["ma_hd", "khoa"], "left")
    else:
        j = j.withColumn("hm_mem", F.lit(None).cast("string"))
    return (j.withColumn("ma_hm", F.coalesce("hm_mem", "hm_key", "hm_name"))
            .withColumn("cach_khop", F.when(F.col("hm_mem").isNotNull(), X.HOW_REMEMBERED)
                        .when(F.col("hm_key").isNotNull(), X.HOW_KEY)
                        .when(F.col("hm_name").isNotNull(), X.HOW_NAME).otherwise(""))
            .select(*items.columns, "ma_hm", "cach_khop"))


def match_line(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Code of an amendment line: explicit code when live, else full key, else unique name and unit."""
    codes = lines.select("ma_hd", F.col("ma_hm").alias("given"), F.col("ma_hm").alias("hm_code"))
    j = name_unit(rows).join(by_key(lines), ["ma_hd", "khoa"], "left").join(by_unique_name(lines), ["ma_hd", "f_name", "f_unit"], "left")
    j = j.join(codes, ["ma_hd", "given"], "left")
    return j.withColumn("matched", F.coalesce("hm_code", "hm_key", "hm_name")).select(*rows.columns, "matched")


def _numbered_bigrams(c: Column) -> Column:
    """Two-letter pieces, the n-th equal piece tagged with n; a shorter text is its own piece."""
    n = F.length(c)
    raw = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(2)))).otherwise(F.array(c))
    return F.transform(raw, lambda g, i: F.concat(
        g, F.lit("#"), F.size(F.filter(F.slice(raw, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def _prefix_index(names: DataFrame, keys: list, freq: DataFrame, threshold: float) -> DataFrame:
    """Rarest pieces of each name, as many as needed for two names at the threshold to share at least one.

    With M matched characters of T, at most T - 2M + 1 matching blocks exist, so at least M - (T - 2M + 1) pieces are
    shared; M >= threshold*T/2 and T >= |a| * 2/(2 - threshold) give the bound used here.
    """
    per_char = (1.5 * threshold - 1.0) * 2.0 / (2.0 - threshold)
    g = names.withColumn("g", F.explode(_numbered_bigrams(F.col("f_name"))))
    g = g.join(freq, keys + ["g"], "left")
    w = W.partitionBy(*keys, "f_name").orderBy(F.coalesce("df", F.lit(0)), "g")      # one short text per group
    n = F.greatest(F.length("f_name") - 1, F.lit(1))
    need = F.greatest(F.ceil(F.length("f_name") * F.lit(per_char) - 1 - 1e-9), F.lit(1))
    return (g.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n - need + 1)
            .select(*keys, "f_name", "g"))


def similar_names(left: DataFrame, right: DataFrame, keys: list, threshold: float = 0.85, measure: str = "ratio") -> DataFrame:
    """Pairs of distinct names (l_name, r_name, score) at or above the threshold within equal keys.

    Exact, without forming all pairs of a large group: names are first made distinct; those under keys with at most `FEW` right
    names are paired as they are, the others joined on shared rare pieces. Right names under keys that the left side doesn't
    have are left out first.
    """
    ln = cut_lineage(left.select(*keys, "f_name").distinct())
    rn = cut_lineage(right.select(*keys, "f_name").join(ln.select(*keys).distinct(), keys, "left_semi").distinct())
    per_key = rn.groupBy(*keys).agg(F.count("*").alias("n"))
    wide = cut_lineage(per_key.filter(F.col("n") > FEW).select(*keys))
    l_few, r_few = ln.withColumnRenamed("f_name", "l_name"), rn.withColumnRenamed("f_name", "r_name")
    if wide.isEmpty():
        cand = l_few.join(r_few, keys).select(*keys, "l_name", "r_name")
    else:
        cand = l_few.join(r_few.join(wide, keys, "left_anti"), keys).select(*keys, "l_name", "r_name")
        ln, rn = ln.join(wide, keys, "left_semi"), rn.join(wide, keys, "left_semi")
        freq = (rn.withColumn("g", F.explode(_numbered_bigrams(F.col("f_name")))).groupBy(*keys, "g").agg(F.count("*").alias("df")))
        li = _prefix_index(ln, keys, freq, threshold).withColumnRenamed("f_name", "l_name")
        ri = _prefix_index(rn, keys, freq, threshold).withColumnRenamed("f_name", "r_name")
        cand = cand.union(li.join(ri, keys + ["g"]).select(*keys, "l_name", "r_name").distinct())
    cand = cand.filter(ratio_upper_bound(F.col("l_name"), F.col("r_name")) >= threshold)
    if measure == "edit":
        longer = F.greatest(F.length("l_name"), F.length("r_name"))
        score = F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein("l_name", "r_name") / longer)
    else:
        score = sequence_ratio("l_name", "r_name")
    return cand.withColumn("score", score).filter(F.col("score") >= threshold)


def fuzzy_suggest(items: DataFrame, lines: DataFrame, threshold: float = 0.85, measure: str = "ratio") -> DataFrame:
    """Best similar line of the same contract and unit per unmatched item; equal scores go to the greatest code."""
    it = items.withColumns({"f_name": fold(F.col("ten")), "f_unit": fold(F.col("dvt"))})
    ln = lines.withColumns({"f_name": fold(F.col("ten")), "f_unit": fold(F.col("dvt"))})
    keys = ["ma_hd", "f_unit"]
    it = cut_lineage(it)
    pairs = cut_lineage(similar_names(it, ln, keys, threshold, measure))
    named = pairs.select(*keys, "r_name").distinct()
    best_line = ln.withColumnRenamed("f_name", "r_name").join(named, keys + ["r_name"], "left_semi").groupBy(*keys, "r_name").agg(F.max("ma_hm").alias("hm"))
    best = (pairs.join(best_line, keys + ["r_name"]).groupBy(*keys, F.col("l_name").alias("f_name"))
            .agg(F.max(F.struct("score", "hm")).alias("b")))
    return (it.join(best, keys + ["f_name"], "left")
            .select(*items.columns, F.col("b.hm").alias("goi_y"), F.col("b.score").alias("goi_y_score")))


def derive_changes(table: DataFrame, current: DataFrame, whole: Column) -> DataFrame:
    """Change lines from a pasted table against the lines in force.

    table: form key ma_hd, matched (code or NULL), kl, don_gia, ten, dvt.  Unlisted lines become removals only where
    ``whole`` (evaluated on the table's form row, column ``whole``) says the table lists everything.
    """
    t = table.withColumn("__t", F.lit(1))
    c = current.select("ma_hd", F.col("ma_hm").alias("matched"), F.col("kl").alias("cur_kl"), F.col("don_gia").alias("cur_gia"),
                       F.lit(1).alias("__c"))
    j = t.join(c, ["ma_hd", "matched"], "full_outer")
    scope = table.groupBy("ma_hd").agg(F.max(whole.cast("int")).alias("__whole"))
    z = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    moved = (F.abs(z("kl") - z("cur_kl")) > 1e-9) | (F.abs(z("don_gia") - z("cur_gia")) > 0.5)
    op = (F.when(F.col("__c").isNull(), X.OP_ADD).when(F.col("__t").isNull() & (F.col("__whole") == 1), X.OP_REMOVE)
          .when(F.col("__t").isNotNull() & F.col("__c").isNotNull() & moved, X.OP_MODIFY))
    return (j.join(scope, "ma_hd").withColumn("thao_tac", op).filter("thao_tac is not null")
            .select("ma_hd", F.col("matched").alias("ma_hm"), "thao_tac",
                    F.when(F.col("thao_tac") != X.OP_REMOVE, F.col("kl")).alias("kl"),
                    F.when(F.col("thao_tac") != X.OP_REMOVE, F.col("don_gia")).alias("don_gia"), "ten"))


def catalogue_differences(catalogue: DataFrame, params: DataFrame) -> DataFrame:
    """Catalogue values that really differ from the stored ones: as folded text, as numbers and (TC-02) as dates."""
    from claimgrid.functions.numbers import date_vn, num
    from claimgrid.schemas import TOL
    s = params.select("ma_hd", "ma_ts", F.trim(F.coalesce("gia_tri", F.lit(""))).alias("stored"))
    j = catalogue.withColumn("listed", F.trim("gia_tri")).join(s, ["ma_hd", "ma_ts"])
    a, b = F.col("listed"), F.col("stored")
    close = F.coalesce(F.abs(num(a) - num(b)) < TOL["catalogue"], F.lit(False))
    same_day = (F.col("ma_ts") == "TC-02") & date_vn(a).eqNullSafe(date_vn(b))
    return j.filter((fold(a) != fold(b)) & ~close & ~same_day).select("ma_hd", "ma_ts", "listed", "stored")
