"""Document, TF-IDF and embedding queries."""

from pyspark.sql import functions as F

from tracewright.catalog.base import register, sql_norm
from tracewright.catalog.runblocks import CHANGES_SQL, STREAK_SQL, cnt
from tracewright.operators import documents as D


def under(x):
    return f"replace({sql_norm(x)}, ' ', '_')"


WORDS_SQL = f"""{CHANGES_SQL}, {STREAK_SQL},
si AS (SELECT run_id, intent, bool_or(len(refs) > 0) AS r, bool_or(type = 'handoff') AS h, count(DISTINCT sender) AS o FROM messages WHERE intent <> '' GROUP BY 1, 2),
sa AS (SELECT run_id, {cnt('NOT r AND h')} AS never, bool_or(o > 1) AS tie FROM si GROUP BY 1),
sh AS (SELECT run_id, bool_or(nm > 1 OR (k > 1 AND d = 1)) AS dup FROM (SELECT run_id, hash, {cnt("subtask <> ''")} AS nm, count(*) AS k, count(DISTINCT subtask) AS d FROM artifacts GROUP BY 1, 2) GROUP BY 1),
ss AS (SELECT run_id, bool_or(flip) AS flip, bool_or(alt_flip OR op = 'override') AS clash FROM changes GROUP BY 1),
sr AS (SELECT run_id, {cnt("norm <> '' AND norm = pn")} AS rep, max(zero_run) AS zero FROM st GROUP BY 1),
sw AS (SELECT r.run_id, concat_ws(' ', CASE WHEN clash THEN '[CONFLICT]' END, CASE WHEN flip THEN '[DEAD]' END, CASE WHEN zero >= 2 AND len(goal_words) > 0 THEN '[DRIFT]' END, CASE WHEN dup THEN '[DUP]' END,
  CASE WHEN rep >= 2 THEN '[LOOP]' END, CASE WHEN never > 0 THEN '[NOKEYWORD]' END, CASE WHEN tie THEN '[REASSIGN]' END, CASE WHEN tie THEN '[TIE]' END, CASE WHEN never >= 2 THEN '[UNANSWERED_MANY]' END) AS line
  FROM runs r LEFT JOIN sa USING (run_id) LEFT JOIN sh USING (run_id) LEFT JOIN ss USING (run_id) LEFT JOIN sr USING (run_id))"""
LINES_SQL = f"""{WORDS_SQL},
lines AS (SELECT run_id, 0 AS section, 0 AS pos, '[GOAL] ' || {sql_norm('goal')} AS line FROM runs
  UNION ALL SELECT m.run_id, 1, t, concat_ws(' ', '[' || upper(type) || ']', CASE WHEN intent <> '' THEN '[SUB] ' || {under('intent')} ELSE '[NOINTENT]' END, '[ROLE] ' || role,
    CASE WHEN norm <> '' THEN norm ELSE '[NOTEXT]' END, CASE WHEN tool <> '' THEN '[TOOL] ' || {under('tool')} END, CASE WHEN is_delivery THEN '[DELIVERED]' END)
    FROM messages m JOIN agents a ON a.run_id = m.run_id AND a.agent = m.sender
  UNION ALL SELECT run_id, 2, t, '[ART] ' || {under('type')} || ' [ARTSTATUS] ' || status FROM artifacts
  UNION ALL SELECT run_id, 3, t, '[STATEKEY] ' || {under('key')} || ' [STATEOP] ' || op FROM state UNION ALL SELECT run_id, 4, 0, line FROM sw WHERE line <> '')"""
register("a28_document_lines", "run_id,section,pos:l line:s", D.document_lines, f"WITH {LINES_SQL}, answer AS (SELECT * FROM lines)")
register("a28_document_text", "run_id:l chars,words:l print:s", lambda tr: D.document_parts(tr).groupBy("run_id").agg(
    (F.sum(F.length("text")) + F.count(F.lit(1)) - 1).alias("chars"), F.sum(F.size(F.split("text", " "))).alias("words"),
    F.max_by(F.md5("text"), F.struct("section", "part")).alias("print")),
    f"""WITH {LINES_SQL}, d AS (SELECT run_id, string_agg(line, ' ' ORDER BY section, pos) AS doc, string_agg(line, ' ' ORDER BY section, pos) FILTER (WHERE section = mx) AS tail
  FROM (SELECT *, max(section) OVER (PARTITION BY run_id) AS mx FROM lines) GROUP BY 1), answer AS (SELECT run_id, len(doc) AS chars, len(string_split(doc, ' ')) AS words, md5(tail) AS print FROM d)""")


def tfidf_sql(src, key):
    return f"""tf AS (SELECT {key}, term, count(*) AS tf FROM {src} GROUP BY 1, 2),
vo AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 5),
wt AS (SELECT {key}, term, (1 + ln(tf)) * (ln((1 + nd) / (1 + df)) + 1) AS w FROM tf JOIN vo USING (term), nd), ln2 AS (SELECT {key}, sqrt(sum(w * w)) AS l FROM wt GROUP BY 1),
answer AS (SELECT {key}, term, w / l AS weight FROM wt JOIN ln2 USING ({key}))"""


register("l11_tfidf_words", "doc_id:l term:s weight:d", lambda tr: D.word_tfidf(tr.spark.read.parquet(f"{tr.sf_dir}/documents.parquet").select("doc_id", F.lower("text").alias("text")), "doc_id"),
         r"""WITH nd AS (SELECT count(*) AS nd FROM documents), dw AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
  tm AS (SELECT doc_id, unnest(w) AS term FROM dw UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM dw), """ + tfidf_sql("tm", "doc_id"))
register("l11_tfidf_chars", "conv_id,turn:l term:s weight:d", lambda tr: D.char_tfidf(tr.spark.read.parquet(f"{tr.sf_dir}/conversations.parquet").select(
    F.struct("conv_id", "turn").alias("k"), F.lower("text").alias("text")), "k").select("k.conv_id", "k.turn", "term", "weight"),
    r"""WITH nd AS (SELECT count(*) AS nd FROM conversations), cw AS (SELECT conv_id * 100000 + turn AS k, ' ' || unnest(regexp_extract_all(lower(text), '\S+')) || ' ' AS w FROM conversations),
  tm AS (SELECT k, substr(w, i, 3) AS term FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM cw) UNION ALL SELECT k, substr(w, i, 4) FROM (SELECT k, w, unnest(range(1, len(w) - 2)) AS i FROM cw)
  UNION ALL SELECT k, substr(w, i, 5) FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM cw)), """ + tfidf_sql("tm", "k").replace(
        "answer AS (SELECT k, term", "answer AS (SELECT k // 100000 AS conv_id, k % 100000 AS turn, term"))
register("a27_pooled_embeddings", "label:l vector:ad", lambda tr: D.pooled_embeddings(tr.spark.read.parquet(f"{tr.sf_dir}/embeddings.parquet"), "label", "embedding"),
         """WITH l AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM l GROUP BY 1, 2),
  s AS (SELECT label, sqrt(sum(x * x)) AS z FROM m GROUP BY 1), answer AS (SELECT label, list(x / greatest(z, 1e-12) ORDER BY dim) AS vector FROM m JOIN s USING (label) GROUP BY 1)""")
register("a4_document_duplicates", "source:s docs,distinct_texts,most_copies:l", lambda tr: tr.spark.read.parquet(f"{tr.sf_dir}/documents.parquet").groupBy("source", "text").agg(
    F.count(F.lit(1)).alias("c")).groupBy("source").agg(F.sum("c").alias("docs"), F.count(F.lit(1)).alias("distinct_texts"), F.max("c").alias("most_copies")),
    "SELECT source, sum(c) AS docs, count(*) AS distinct_texts, max(c) AS most_copies FROM (SELECT source, text, count(*) AS c FROM documents GROUP BY 1, 2) GROUP BY 1")
