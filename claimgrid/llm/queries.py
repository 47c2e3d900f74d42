"""Registered queries of this subpackage: thin, over whole tables, with the production parameters of their operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from claimgrid.llm import chat, cotrain, decontaminate, exact_topk, filter_audit, html_text, imatch, language_id, mixing, prefix_trie, simhash, successor, token_counts, token_store
from claimgrid.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op3_token_counts")
def op3(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op7_token_files")
def op7(spark, sf_dir):
    return token_store.read_documents(token_store.write_tokens(table(spark, sf_dir, "documents"), TOKENIZER))


@query("op9_simhash_groups")
def op9(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs), returned=["doc_id"])
    label, score, entropy, rejected = found.columns[-4:]
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), F.col(label).alias("lang_pred"), F.col(score).alias("score"), F.col(entropy).alias("entropy"), F.col(rejected).alias("rejected"))


@query("op1_mixing")
def op1(spark, sf_dir):
    found = mixing.mix(table(spark, sf_dir, "documents"), texts=False)
    taken = F.col("mix_size") * F.size("mix_draws")
    return found.select("row.doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"), "row.source", F.col("mix_draws.shard").alias("shards"))


@query("op4_decontamination")
def op4(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Fixed text of the contract's extra conversation.
EXTRA_TURN = "</s>[INST] ok [/INST]"

OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(regexp_replace(r, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(t, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query("op2_chat_format", OP2_SQL)
def op2(spark, sf_dir):
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TURN).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_chats(chat.log_of(rows))
    turns = chat.read_turns(F.col("formatted"))
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: chat.unescape(p["text"])), "")
    done = done.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query("op6_html_text")
def op6(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op8_imatch")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = imatch.lexicon(docs)
    rows = successor.spanned(docs.withColumns({"n_chars": F.length("text").cast("long"), "tie": F.xxhash64("text")}))
    order = ["doc_id", "tie", "text"]
    inner = successor.inner_pairs(imatch.with_fingerprint(rows, words, "text", "fingerprint"), {"next_text": "text", "next_fingerprint": "fingerprint"}, order)
    outer = successor.outer_pairs(rows, {"next_text": "text"}, order)
    outer = imatch.with_fingerprint(imatch.with_fingerprint(outer, words, "text", "fingerprint"), words, "next_text", "next_fingerprint")
    pairs = inner.unionByName(outer)
    edited = F.expr("concat(substring(text, 1, cast(n_chars - floor(n_chars / 4) as int)), substring(next_text, 1, cast(floor(n_chars / 4) as int)))")
    pairs = pairs.select("doc_id", "n_chars", edited.alias("edited"), "fingerprint", "next_fingerprint")
    done = imatch.with_fingerprint(pairs, words, "edited", "edited_fingerprint")
    return done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", imatch.likeness("fingerprint", "edited_fingerprint").alias("near_edited"), imatch.likeness("fingerprint", "next_fingerprint").alias("near_next"))


@query("op10_quality")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return cotrain.score(docs, cotrain.train(docs, table(spark, sf_dir, "labels")))


OP11_SQL = """
WITH numbered AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT n, vec_id, unnest(w) AS w, generate_subscripts(w, 1) AS t FROM numbered),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.n AS other, c.vec_id, coalesce(sum(a.w * b.w), 0)::BIGINT AS score
  FROM numbered q JOIN numbered c ON c.n <> q.n JOIN parts a ON a.n = q.n LEFT JOIN parts b ON b.n = c.n AND b.t = a.t
  WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op11_exact_topk", OP11_SQL)
def op11(spark, sf_dir):
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


#: crc: CRC-32 of a decimal number bit by bit, each digit followed by eight shifts.
OP12_SQL = """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT i.c, 0 AS side, t.place, t.r, t.t FROM ids i JOIN turns t ON t.c = i.c - i.c % 5 AND t.place <= i.h
  UNION ALL SELECT i.c, 1, t.place, t.r, t.t FROM ids i JOIN turns t ON t.c = i.c AND t.place > i.h),
chain AS (
  SELECT c, row_number() OVER w AS d, list(sha256(strlen(r) || ':' || r || t)) OVER w AS path, strlen(t) AS size FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY side, place)
  UNION ALL SELECT c, 0, [], 0 FROM ids),
ends AS (SELECT c, max(d) AS d FROM chain GROUP BY c),
nodes AS (SELECT d, path, min(c) AS conv_id, count(*) AS n, max(size) AS size FROM chain GROUP BY d, path),
family AS (SELECT a.d, a.path, b.d AS below, b.n, b.size, NOT EXISTS (SELECT 1 FROM nodes k WHERE k.d = b.d + 1 AND k.path[1:b.d] = b.path) AS leaf
  FROM nodes a JOIN nodes b ON b.d >= a.d AND b.path[1:a.d] = a.path),
sums AS (SELECT d, path, sum((below = d + 1)::INT)::BIGINT AS n_children, sum(leaf::INT)::BIGINT AS n_leaves, sum((n - 1) * size)::BIGINT AS saved_tokens FROM family GROUP BY d, path),
stops AS (SELECT d, path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM chain JOIN ends USING (c, d) GROUP BY d, path)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, s.n_children, s.n_leaves, s.saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.path = n.path LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1] LEFT JOIN stops e ON e.d = n.d AND e.path = n.path
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.sequences(prefix_trie.rebuilt_turns(table(spark, sf_dir, "conversations"))))


OP13_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
docs AS (
  SELECT part, doc_id IN (SELECT doc_id FROM good) AS good, doc_id IN (SELECT doc_id FROM toxic) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS failed
  FROM texts),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM orders),
walk AS (
  SELECT part, s.filter_order, s.step, s.filter_order[s.step] AS f, good, toxic, failed, contains(failed, s.filter_order[s.step]) AS fails,
    len(list_filter(string_split(s.filter_order[1:s.step - 1], ''), lambda x: x <> '' AND contains(failed, x))) > 0 AS gone
  FROM docs, steps s),
counts AS (
  SELECT part, filter_order, step, f, count(*) FILTER (NOT gone AND NOT fails)::BIGINT AS kept, count(*) FILTER (fails AND NOT gone)::BIGINT AS removed,
    count(*) FILTER (fails AND gone)::BIGINT AS redundant, count(*) FILTER (failed = f)::BIGINT AS unique_fails,
    count(*) FILTER (fails AND NOT gone AND good)::BIGINT AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic)::BIGINT AS toxic_lost
  FROM walk GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counts
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark, sf_dir):
    return filter_audit.audit(filter_audit.document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
