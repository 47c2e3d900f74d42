"""Paragraph model, rule-based extraction, consistency checks, comparison of two extractors, scoring."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrid import fixed as X
from claimgrid.functions.numbers import canonical_value, numbers_in_text, typed_ai_value, vn_number
from claimgrid.functions.text import content_key, fold, mask_pii, python_strip, squeeze
from claimgrid.schemas import pyround
from claimgrid.session import cut_lineage

I = "(?iuU)"


def split_paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of each text in order: trimmed, blanks collapsed, empty and table-of-contents lines dropped."""
    lines = docs.select(F.col(doc), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("pos", "raw"))
    t = F.trim(F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
    return (lines.filter((t != "") & ~t.rlike(X.TOC_LINE))
            .select(F.col(doc), F.col("pos").cast("bigint").alias("pos"), squeeze(t).alias("text")))


def join_cells(cells: Column) -> Column:
    """One text line for a table row: distinct trimmed cells, inner line breaks shown as ' / '."""
    clean = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c != "")
    return F.array_join(F.transform(F.array_distinct(clean), lambda c: F.replace(c, F.lit("\n"), F.lit(" / "))), " | ")


def in_document(order: str | None = "pos"):
    """The paragraphs of one document. A text came from one value, so its paragraphs fit in a task; all steps below share the
    one exchange by doc_id."""
    w = W.partitionBy("doc_id")
    return w.orderBy(order) if order else w


def carry_section(paras: DataFrame) -> DataFrame:
    """Title of the clause each paragraph belongs to."""
    t = F.col("text")
    title = F.trim(F.concat(F.lit("Điều "), F.regexp_extract(t, I + X.CLAUSE, 1), F.lit(". "), F.regexp_extract(t, I + X.CLAUSE, 2)))
    so_far = in_document().rowsBetween(W.unboundedPreceding, 0)
    return paras.withColumn("section", F.coalesce(F.last(F.when(t.rlike(I + X.CLAUSE), title), ignorenulls=True).over(so_far), F.lit("")))


def relevant_sections(paras: DataFrame, keep: str = X.KEEP_SECTIONS) -> DataFrame:
    """Preamble and payment-related clauses without signature-table rows."""
    sig = F.col("text").contains(" | ") & F.col("text").rlike(X.SIGNATURE_ROW)
    return paras.filter(((F.col("section") == "") | F.col("section").rlike(I + keep)) & ~sig)


def number_paragraphs(paras: DataFrame) -> DataFrame:
    """Dense position (0-based) in the document."""
    return paras.withColumn("n", F.row_number().over(in_document()).cast("bigint") - 1)


def body_only(paras: DataFrame) -> DataFrame:
    """From twelve paragraphs before the first legal basis on (whole text where there is none)."""
    p = paras if "n" in paras.columns else number_paragraphs(paras)
    start = F.min(F.when(F.col("text").startswith(X.BODY_START), F.col("n"))).over(in_document(None))
    return p.withColumn("__start", F.coalesce(start, F.lit(0)) - X.BODY_LEAD).filter(F.col("n") >= F.col("__start")).drop("__start")


def group_no(pattern: str, name: str) -> int:
    """Index of a named group in a Java pattern."""
    return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groupindex[name]


def _value(kind: str, pattern: str, t: Column) -> tuple[Column, Column]:
    """(number, text) a rule reads from a matching paragraph."""
    none_n, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def g(name):
        return F.regexp_extract(t, I + pattern, group_no(pattern, name))

    if kind == "day":
        return none_n, F.concat_ws("/", F.lpad(g("d"), 2, "0"), F.lpad(g("m"), 2, "0"), g("y"))
    v = g("v")
    if kind == "text":
        return none_n, python_strip(v, " .;:")
    if kind == "percent":
        return vn_number(v) / 100, none_s
    if kind == "money":
        return vn_number(v), none_s
    if kind == "integer":
        return v.try_cast("double"), none_s
    if kind == "vat_included":
        return none_n, F.when(v.contains("đã"), "Có").otherwise("Không")
    if kind == "advance":
        no = F.lower(v).contains("không")
        return F.when(~no, vn_number(F.regexp_replace(v, "[% ]+$", "")) / 100), F.when(no, "Không áp dụng")
    raise ValueError(kind)


def rule_hits(paras: DataFrame, rules: list | None = None) -> DataFrame:
    """Every (paragraph, rule) hit with a readable value."""
    t = F.col("text")
    cands = []
    for code, kind, pat in rules or X.RULES:
        n, s = _value(kind, pat, t)
        lab = F.regexp_extract(t, I + pat, group_no(pat, "lab")) if "(?<lab>" in pat else F.lit(None).cast("string")
        word = F.col("__low").contains(X.RULE_WORD[code]) if code in X.RULE_WORD else F.lit(True)
        cands.append(F.when(word & t.rlike(I + pat), F.struct(F.lit(code).alias("ma"), n.alias("v_num"), s.alias("v_str"), lab.alias("lab"))))
    hits = paras.withColumn("__low", F.lower(t)).select("doc_id", "pos", "section", "text", F.explode(F.array_compact(F.array(*cands))).alias("h"))
    return hits.select("doc_id", "pos", "section", "text", "h.*").filter(F.col("v_num").isNotNull() | F.col("v_str").isNotNull())


def first_hits(hits: DataFrame) -> DataFrame:
    """First hit per (document, rule) in body order."""
    return (hits.groupBy("doc_id", "ma").agg(F.min(F.struct("pos", "v_num", "v_str", "lab", "section", "text")).alias("h"))
            .select("doc_id", "ma", "h.*"))


def lists_after_heading(body: DataFrame, rules: list | None = None) -> DataFrame:
    """'+' lines that follow a heading, up to the next heading of the rule: lines before the first '+' line are passed over, the
    first other line after an item ends the list. The first heading with an item counts."""
    t = F.col("text")
    b = body if "n" in body.columns else number_paragraphs(body)
    found = []
    for code, pat in rules or X.LIST_RULES:
        found.append(F.when(t.rlike(I + pat), F.lit(code)))
    # a paragraph takes part once for each rule whose heading stands before it
    head = F.struct("n", "pos", "section", "text")
    so_far = in_document().rowsBetween(W.unboundedPreceding, 0)
    last = [F.last(F.when(f.isNotNull(), F.struct(f.alias("ma"), head.alias("h"))), ignorenulls=True).over(so_far) for f in found]
    p = b.withColumn("__heads", F.array_compact(F.array(*last))).select("doc_id", "n", "text", F.explode("__heads").alias("r"))
    p = p.select("doc_id", "n", "r.ma", "r.h", t.startswith("+").alias("plus"), python_strip(F.regexp_replace("text", r"^[+ ]+", ""), " ;.").alias("i")).filter(F.col("n") > F.col("h.n"))
    item = F.col("plus") & ~F.col("i").rlike(I + X.LIST_SKIP)
    seg = W.partitionBy("doc_id", "ma", "h.n")
    p = p.withColumn("__first", F.min(F.when(item, F.col("n"))).over(seg))
    p = p.withColumn("__stop", F.min(F.when(~F.col("plus") & (F.col("n") > F.col("__first")), F.col("n"))).over(seg))
    g = (p.filter(item & (F.col("__stop").isNull() | (F.col("n") < F.col("__stop"))))
         .groupBy("doc_id", "ma", "h").agg(F.array_sort(F.collect_list(F.struct("n", "i")))["i"].alias("items"))
         .groupBy("doc_id", "ma").agg(F.min(F.struct("h", "items")).alias("g")))
    return g.select("doc_id", "ma", F.col("g.h.pos").alias("pos"), F.col("g.h.section").alias("section"), F.col("g.h.text").alias("text"), F.col("g.items").alias("items"))


def extract_params(paras: DataFrame) -> DataFrame:
    """All 36 parameters of every document: value, how it was found, clause and quotation."""
    body = cut_lineage(body_only(paras if "section" in paras.columns else carry_section(paras)))
    one = first_hits(rule_hits(body)).withColumn("items", F.lit(None).cast("array<string>"))
    lst = lists_after_heading(body).select("doc_id", "ma", "pos", F.lit(None).cast("double").alias("v_num"), F.array_join("items", "; ").alias("v_str"),
                                           F.lit(None).cast("string").alias("lab"), "section", "text", "items")
    hits = one.select(*lst.columns).unionByName(lst)
    codes = F.array(*[F.struct(F.lit(c).alias("ma"), F.lit(u).alias("don_vi")) for c, _g, _n, u in X.PARAMETERS])
    grid = paras.select("doc_id").distinct().select("doc_id", F.inline(codes))
    j = grid.join(hits, ["doc_id", "ma"], "left")
    found = F.col("v_num").isNotNull() | F.col("v_str").isNotNull()
    j = j.select("doc_id", "ma", "don_vi", "v_num", "v_str", F.when(found, "Tự động").otherwise("Không tìm thấy").alias("cach"),
                 F.coalesce("section", F.lit("")).alias("dieu"), F.coalesce("text", F.lit("")).alias("trich"), "lab", "items")
    return derive_params(j)


def derive_params(rows: DataFrame) -> DataFrame:
    """Retention from the payment rate; recovery not applicable where there is no advance."""
    src = rows.filter(F.col("ma").isin("TT-20", "TT-10")).groupBy("doc_id").agg(
        F.max(F.when((F.col("ma") == "TT-20") & F.col("v_num").isNotNull(), F.struct("v_num", "dieu", "trich"))).alias("p20"),
        F.max(F.when(F.col("ma") == "TT-10", F.col("v_str"))).alias("p10"))
    j = rows.join(src, "doc_id", "left")
    empty = F.col("v_num").isNull() & F.col("v_str").isNull()
    d21 = (F.col("ma") == "TT-21") & empty & F.col("p20").isNotNull()
    d11 = (F.col("ma") == "TT-11") & empty & (F.col("p10") == "Không áp dụng")
    d21, d11 = F.coalesce(d21, F.lit(False)), F.coalesce(d11, F.lit(False))
    return j.select(
        "doc_id", "ma", "don_vi", F.when(d21, pyround(1 - F.col("p20.v_num"), 4)).otherwise(F.col("v_num")).alias("v_num"),
        F.when(d11, "Không áp dụng").otherwise(F.col("v_str")).alias("v_str"),
        F.when(d21, "Suy ra = 100% - TT-20").when(d11, "Suy ra từ TT-10").otherwise(F.col("cach")).alias("cach"),
        F.when(d21, F.col("p20.dieu")).otherwise(F.col("dieu")).alias("dieu"),
        F.when(d21, F.col("p20.trich")).otherwise(F.col("trich")).alias("trich"), "lab", "items")


def party_label_check(rows: DataFrame) -> DataFrame:
    """Party rows whose label in parentheses names the wrong side."""
    lab = F.upper(F.coalesce("lab", F.lit("")))
    want = F.when(F.col("ma") == "TC-06", X.PARTY_LABELS["TC-06"]).when(F.col("ma") == "TC-07", X.PARTY_LABELS["TC-07"])
    found = F.col("v_str").isNotNull()
    return rows.filter(want.isNotNull() & found & ~lab.contains(want)).select("doc_id", "ma", lab.alias("lab"))


def consistency_checks(paras: DataFrame, rows: DataFrame) -> DataFrame:
    """Drafting errors: redefined party, digits against words, contradictory clauses -> (doc_id, ma, kind, detail)."""
    t = F.col("text")
    a = rows.filter((F.col("ma") == "TC-06") & F.col("v_str").isNotNull()).select("doc_id", F.col("v_str").alias("party_a"))
    d = F.regexp_extract(t, "(?U)" + X.PARTY_DEFINITION, 1)
    redefined = (paras.withColumn("named", d).filter(F.col("named") != "").join(a, "doc_id")
                 .filter(fold(F.col("named")) != fold(F.col("party_a")))
                 .select("doc_id", F.lit("TC-06").alias("ma"), F.lit("party").alias("kind"), F.col("named").alias("detail")))
    words = F.create_map(*[F.lit(v) for kv in X.NUMBER_WORDS.items() for v in kv])
    pat = F.lit(I + X.NUMBER_IN_WORDS)
    pairs = F.arrays_zip(F.regexp_extract_all(t, pat, 0).alias("m"), F.regexp_extract_all(t, pat, 1).alias("n"), F.regexp_extract_all(t, pat, 2).alias("w"))
    numbers = (paras.select("doc_id", F.explode(pairs).alias("p"))
               .filter(F.element_at(words, F.lower(F.trim("p.w"))) != F.col("p.n").cast("int"))
               .select("doc_id", F.lit("TC-08").alias("ma"), F.lit("number").alias("kind"), F.col("p.m").alias("detail")))
    both = (paras.groupBy("doc_id").agg(F.bool_or(t.rlike(I + X.NEEDS_PARTY_B)).alias("y"), F.bool_or(t.rlike(I + X.WITHOUT_PARTY_B)).alias("n"))
            .filter("y and n").select("doc_id", F.lit("TT-56").alias("ma"), F.lit("contradiction").alias("kind"), F.lit("").alias("detail")))
    return redefined.unionByName(numbers).unionByName(both)


def required_documents(rows: DataFrame) -> DataFrame:
    """One row per document the contract asks for."""
    return (rows.filter(F.col("ma").isin("TT-60", "TT-61") & F.col("items").isNotNull())
            .select("doc_id", F.when(F.col("ma") == "TT-60", "Mỗi đợt").otherwise("Quyết toán").alias("loai"),
                    F.explode("items").alias("tai_lieu"), F.col("dieu").alias("dieu_khoan")))


def listed_documents(paras: DataFrame) -> DataFrame:
    """The documents each contract asks for, from its text: only the lists are read, the other parameters are not worked out, and
    all steps share the one exchange by doc_id."""
    lists = lists_after_heading(body_only(paras if "section" in paras.columns else carry_section(paras)))
    return required_documents(lists.withColumn("dieu", F.coalesce("section", F.lit(""))))


# --- second extractor ------------------------------------------------------------------------------------------
ANSWER = "map<string,struct<gia_tri:string,don_vi:string,dieu_khoan:string,trich_dan:string,ghi_chu:string>>"


def parse_answers(raw: DataFrame, doc: str = "doc_id", text: str = "raw") -> DataFrame:
    """Raw model answers -> one row per code, from the outermost braces."""
    body = F.regexp_extract(F.col(text), r"(?s)(\{.*\})", 1)
    m = F.from_json(F.when(body != "", body).otherwise(F.col(text)), ANSWER)
    return raw.select(F.col(doc).alias("doc_id"), F.explode(m).alias("ma", "a")).select("doc_id", "ma", "a.*")


def compare_extractors(rows: DataFrame, answers: DataFrame, full_text: DataFrame) -> DataFrame:
    """Agreement of the rules and the answers per parameter, and whether each quotation is in the text.

    full_text: doc_id, folded (folded original followed by the folded masked text).
    """
    a = answers.select("doc_id", "ma", F.col("gia_tri").alias("ai"), F.coalesce("trich_dan", F.lit("")).alias("trich_ai"),
                       F.coalesce("dieu_khoan", F.lit("")).alias("dieu_ai"), F.coalesce("ghi_chu", F.lit("")).alias("ghi_chu_ai"))
    # texts and answers are many times the size that the plan expects of them: never broadcast
    j = rows.join(a.hint("merge"), ["doc_id", "ma"], "left").join(full_text.hint("merge"), "doc_id", "left")
    ai = F.when(F.upper(F.trim("ai")) != X.NOT_FOUND, F.col("ai"))
    c1 = canonical_value(F.col("v_str"), F.col("v_num"))
    j = j.withColumn("c1", c1).withColumn("c2", canonical_value(ai))
    n1, n2 = F.col("c1.n"), F.col("c2.n")
    s1 = F.coalesce(F.col("c1.s"), n1.cast("string"))
    s2 = F.coalesce(F.col("c2.s"), n2.cast("string"))
    agree = (F.when(s1.isNull() & s2.isNull(), X.BOTH_NONE).when(s2.isNull(), X.ONLY_RULE).when(s1.isNull(), X.ONLY_AI)
             .when(n1.isNotNull() & n2.isNotNull(), F.when(F.abs(n1 - n2) <= F.greatest(F.lit(1e-6), F.abs(n1) * 1e-9), X.EQUAL).otherwise(X.DIFFERENT))
             .when(s2.contains(s1) | s1.contains(s2), X.EQUAL).otherwise(X.REWORDED))
    return j.withColumn("khop", agree).withColumn("that", verify_quote(F.col("trich_ai"), F.col("folded"))).drop("c1", "c2", "folded")


def verify_quote(quote: Column, folded_text: Column) -> Column:
    """Whole quotation in the text; or half of its runs of six words; or neither."""
    q = fold(quote)
    words = F.split(q, r"\s+")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / X.QUOTE_RUN).cast("int")), lambda k: F.array_join(F.slice(words, k * X.QUOTE_RUN + 1, X.QUOTE_RUN), " "))
    found = F.size(F.filter(runs, lambda r: folded_text.contains(r)))
    return (F.when(q == "", "").when(folded_text.contains(q), X.QUOTE_YES)
            .when(found * 2 >= F.size(runs), X.QUOTE_NEAR).otherwise(X.QUOTE_NO))


def folded_documents(docs: DataFrame, parties: DataFrame | None = None) -> DataFrame:
    """Folded text of each document, followed by its folded masked form when the party names are given."""
    if parties is None:
        return docs.select("doc_id", fold(F.col("text")).alias("folded"))
    masked = mask_pii(F.col("text"), F.col("party_a"), F.col("party_b"))
    return docs.join(parties.hint("merge"), "doc_id", "left").select(
        "doc_id", F.concat(fold(F.col("text")), F.lit("\n"), fold(F.coalesce(masked, F.lit("")))).alias("folded"))


def parties_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.max(F.when(F.col("ma") == "TC-06", F.col("v_str"))).alias("party_a"),
                                      F.max(F.when(F.col("ma") == "TC-07", F.col("v_str"))).alias("party_b"))


def fill_from_ai(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Missing parameters take the answer as it stands."""
    a = answers.filter(~F.col("gia_tri").isin("", "null", X.NOT_FOUND)).select(
        "doc_id", "ma", F.col("gia_tri").alias("ai"), F.coalesce("trich_dan", F.lit("")).alias("q"), F.coalesce("dieu_khoan", F.lit("")).alias("k"))
    j = rows.join(a.hint("merge"), ["doc_id", "ma"], "left")
    use = F.col("v_num").isNull() & F.col("v_str").isNull() & F.col("ai").isNotNull()
    return j.select("doc_id", "ma", "don_vi", "v_num", F.when(use, F.col("ai")).otherwise(F.col("v_str")).alias("v_str"),
                    F.when(use, "Local AI").otherwise(F.col("cach")).alias("cach"), F.when(use, F.col("k")).otherwise(F.col("dieu")).alias("dieu"),
                    F.when(use, F.col("q")).otherwise(F.col("trich")).alias("trich"))


def merge_sources(cmp: DataFrame) -> DataFrame:
    """Rule values stay; an answer fills a gap only when its quotation is in the text.  Adds the state of each parameter."""
    has = F.col("v_num").isNotNull() | F.col("v_str").isNotNull()
    invented = F.col("that") == X.QUOTE_NO
    k = F.when((F.col("khop") == X.REWORDED) & has & F.coalesce(F.col("ai").rlike(X.MASK_TAG), F.lit(False)), X.EQUAL).otherwise(F.col("khop"))
    st = (F.when(k == X.ONLY_AI, F.when(invented, X.STATE_INVENTED).otherwise(X.ONLY_AI))
          .when(k == X.BOTH_NONE, X.STATE_MISSING).otherwise(k))
    take = (k == X.ONLY_AI) & ~invented
    val = typed_ai_value(F.col("ai"), F.col("don_vi"))
    ai_note = (F.col("ghi_chu_ai") != "") & (k != X.ONLY_AI) & F.col("ghi_chu_ai").rlike(I + X.AI_REMARK)
    note = F.concat_ws(
        "; ", F.when(st == X.STATE_INVENTED, F.concat(F.lit("AI ghi '"), "ai", F.lit("' nhưng trích dẫn không có trong HĐ – không dùng"))),
        F.when(take, F.concat(F.lit("Giá trị do AI trích – đọc trích dẫn trước khi xác nhận"),
                              F.when(F.col("ghi_chu_ai") != "", F.concat(F.lit("; AI ghi chú: "), "ghi_chu_ai")).otherwise(""))),
        F.when(k == X.DIFFERENT, F.concat(F.lit("LỆCH: AI đọc là '"), "ai", F.lit("'"),
                                          F.when(F.col("dieu_ai") != "", F.concat(F.lit(" ("), "dieu_ai", F.lit(")"))).otherwise(""), F.lit(" – đọc lại điều khoản"))),
        F.when(k == X.REWORDED, F.concat(F.lit("AI ghi: '"), "ai", F.lit("'"))),
        F.when((k == X.EQUAL) & invented, "AI cùng giá trị nhưng trích dẫn không đúng nguyên văn"),
        F.when(ai_note, F.concat(F.lit("AI lưu ý: "), "ghi_chu_ai")))
    return cmp.select(
        "doc_id", "ma", "don_vi", F.when(take, val["n"]).otherwise(F.col("v_num")).alias("v_num"), F.when(take, val["s"]).otherwise(F.col("v_str")).alias("v_str"),
        F.when(take, "Local AI (quy tắc không thấy)").when(k == X.EQUAL, F.concat("cach", F.lit(" + AI khớp"))).otherwise(F.col("cach")).alias("cach"),
        F.when(take, F.col("dieu_ai")).otherwise(F.col("dieu")).alias("dieu"), F.when(take, F.col("trich_ai")).otherwise(F.col("trich")).alias("trich"),
        st.alias("tinh_trang"), note.alias("ghi_chu"), "ai")


def missing_mandatory(rows: DataFrame) -> DataFrame:
    """Mandatory codes without a value per document; payment and retention rates stand in for each other."""
    miss = F.col("v_num").isNull() & F.col("v_str").isNull() & F.col("ma").isin(X.MANDATORY_CODES)
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(miss, F.col("ma")))).alias("m"))
    pair = F.array(F.lit("TT-20"), F.lit("TT-21"))
    return g.select("doc_id", F.when(F.size(F.array_intersect("m", pair)) == 1, F.array_except("m", pair)).otherwise(F.col("m")).alias("thieu"))


def to_confirm(merged: DataFrame) -> DataFrame:
    """Rows a person has to look at, most serious state first; a missing value counts only for mandatory codes."""
    rank = F.array_position(F.array(*[F.lit(s) for s in X.REVIEW_STATES]), F.col("tinh_trang"))
    need = (rank > 0) & ~((F.col("tinh_trang") == X.STATE_MISSING) & ~F.col("ma").isin(X.MANDATORY_CODES))
    return merged.withColumn("rank", rank).filter(need)


def score_vs_gold(result: DataFrame, gold: DataFrame) -> DataFrame:
    """Grade each gold value: numbers by the first number, texts by the share of gold words found."""
    j = gold.select("doc_id", "ma", F.col("gia_tri").alias("g"), F.col("don_vi").alias("g_unit")).join(
        result.select("doc_id", "ma", F.col("gia_tri").alias("v"), F.coalesce("trich", F.lit("")).alias("trich")), ["doc_id", "ma"], "left")
    pct = F.trim("g_unit").startswith("%")
    j = j.withColumns({"pct": pct, "gn": numbers_in_text(F.col("g"), pct), "vc": canonical_value(F.col("v")),
                       "kn": numbers_in_text(F.concat_ws(" ", "trich", "v"), pct)})
    nothing = F.col("v").isNull() | (F.col("v") == "") | F.upper(F.trim("v")).isin(X.NOT_FOUND, "(THIẾU)")
    first = F.try_element_at("gn", F.lit(1))
    n = F.col("vc.n")
    near = (F.abs(n - first) < 1e-9) | (F.abs(n * 100 - first * F.when(F.col("pct"), 100).otherwise(1)) < 1e-9)
    extra = F.exists(F.slice("gn", F.lit(2), F.greatest(F.size("gn"), F.lit(0))), lambda x: ~F.exists("kn", lambda y: F.abs(x - y) < 1e-9))
    words = lambda c: F.array_distinct(F.regexp_extract_all(fold(c), F.lit("([a-z0-9]+)"), 1))
    gw = F.array_except(words(F.col("g")), F.array(*[F.lit(s) for s in X.SCORE_STOP_WORDS]))
    kw = words(F.concat_ws(" ", "v", "trich"))
    r = F.when(F.size(gw) > 0, F.size(F.array_intersect(gw, kw)) / F.size(gw)).otherwise(0.0)
    numeric = n.isNotNull() & (F.size("gn") > 0)
    grade = (F.when(nothing, X.WRONG).when(numeric, F.when(near, F.when(extra, X.PARTIAL).otherwise(X.CORRECT)).otherwise(X.WRONG))
             .when(r >= 0.8, X.CORRECT).when(r >= 0.4, X.PARTIAL).otherwise(X.WRONG))
    return j.select("doc_id", "ma", grade.alias("cham"), F.when(~nothing & ~numeric, r).alias("ty_le"))


def score_summary(graded: DataFrame, per: list | None = None) -> DataFrame:
    c = lambda s: F.count(F.when(F.col("cham") == s, 1))
    return graded.groupBy(*(per or [])).agg(
        c(X.CORRECT).alias("dung"), c(X.PARTIAL).alias("mot_phan"), c(X.WRONG).alias("sai"),
        ((c(X.CORRECT) + 0.5 * c(X.PARTIAL)) / F.count("*")).alias("diem"))


def token_overlap(a: Column, b: Column, stop: list) -> tuple[Column, Column]:
    """(shared tokens, tokens of a missing in b) without stop words."""
    sw = F.array(*[F.lit(s) for s in stop])
    ta = F.array_except(F.array_distinct(F.regexp_extract_all(fold(a), F.lit("([a-z0-9]+)"), 1)), sw)
    tb = F.array_distinct(F.regexp_extract_all(fold(b), F.lit("([a-z0-9]+)"), 1))
    return F.array_intersect(ta, tb), F.array_except(ta, tb)


def request_plan(docs: DataFrame) -> DataFrame:
    """Requests per (document, parameter group): the codes asked together."""
    groups: dict = {}
    for code, group, _n, _u in X.PARAMETERS:
        groups.setdefault(group, []).append(code)
    spec = F.array(*[F.struct(F.lit(g).alias("nhom"), F.array(*[F.lit(c) for c in cs]).alias("codes")) for g, cs in groups.items()])
    return docs.select("doc_id", F.inline(spec))


def resume_missing(docs: DataFrame, done: DataFrame, model: Column, masked: Column, whole: Column) -> DataFrame:
    """Documents whose content key has no stored answer yet."""
    return docs.withColumn("key", content_key(F.col("text"), model, masked, whole)).join(done.select("key").distinct(), "key", "left_anti")


def token_usage(log: DataFrame) -> DataFrame:
    return log.groupBy("doc_id").agg(F.sum("token_vao").alias("token_vao"), F.sum("token_ra").alias("token_ra"), F.round(F.sum("giay"), 1).alias("giay"))
