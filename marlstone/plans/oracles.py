"""DuckDB SQL with the same rows as the queries."""

from __future__ import annotations

from ..functions import prompts, text

_CTES = {
    "posts": """
      SELECT e.event_type AS ticker, CAST(e.ts AS DATE) AS date, e.event_id AS line_no, e.event_id AS id, e.user_id AS author_id,
             e.ts AS created_at, CASE WHEN e.event_id % 11 = 0 THEN 'No information available' ELSE d.text END AS "text"
      FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents) z JOIN documents d ON d.doc_id = e.event_id % z.n""",
    "bars": """
      SELECT *, CAST(cents AS DOUBLE) / nullif(lag(cents) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS pct FROM (
        SELECT event_type AS ticker, CAST(ts AS DATE) AS date, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM events GROUP BY ALL)""",
    "bars_long": """
      SELECT *, CAST(cents AS DOUBLE) / nullif(lag(cents) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS pct FROM (
        SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM orders GROUP BY ALL)""",
    "days": """
      SELECT ticker, date, CASE WHEN pct > 0 AND NOT isnan(pct) THEN 'Positive' ELSE 'Negative' END AS target FROM bars""",
    "placed": """
      SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n FROM bars""",
    "summaries": """
      SELECT ticker, date AS day, string_agg("text", chr(10) ORDER BY line_no) AS summary
      FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY line_no) AS rn FROM posts) WHERE rn <= 3 GROUP BY ALL""",
    "slots": """
      SELECT ticker, date, date - CAST(k AS INTEGER) AS day FROM bars, unnest([1, 2, 3, 4, 5]) AS u(k)""",
    "answers": """
      SELECT doc_id, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS label,
        CASE doc_id % 5
          WHEN 0 THEN '**Stock Return:** 2.5% (' || up || ')'
          WHEN 1 THEN 'Summary: x' || chr(10) || 'Stock Return: -1.2% (' || upper(up) || ')'
          WHEN 2 THEN 'stock return : +3 ( ' || up || ' ) (down)'
          WHEN 3 THEN 'Stock Return: 2% ' || up ELSE 'no idea' END AS response
      FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'down' ELSE 'up' END AS up FROM labels)""",
    "moves": r"""
      SELECT doc_id, label, CASE regexp_extract(replace(lower(trim(response)), '**', ''), 'stock\s*return\s*:\s*[-+]?\d+(?:\.\d+)?\s*%?\s*\(\s*(up|down)\s*\)', 1)
        WHEN 'up' THEN 'Positive' WHEN 'down' THEN 'Negative' ELSE 'Unknown' END AS prediction FROM answers""",
    "judged": """
      SELECT m.*, d.lang, label = 'Positive' AS a,
        CASE WHEN prediction = 'Unknown' THEN label <> 'Positive' ELSE prediction = 'Positive' END AS p
      FROM moves m JOIN documents d USING (doc_id)""",
    "entities": """
      SELECT 's' || s_suppkey AS id, s_name AS entity, 'COMP' AS type_name FROM supplier
      UNION ALL SELECT 'c' || c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'COMP' ELSE 'PERSON' END FROM customer
      UNION ALL SELECT 'p' || p_partkey, p_name, 'PRODUCT' FROM part""",
    "relations": "SELECT * FROM (VALUES ('A', 'supplies'), ('R', 'returns to')) t(id, relation)",
    "quads": """
      SELECT 's' || l_suppkey AS subj_id, l_returnflag AS rel_id, 'c' || o_custkey AS obj_id,
             CAST(date_trunc('week', l_shipdate) AS DATE) AS date_wk, l_linestatus AS source_file
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "mapping": """
      SELECT 'S' || s_suppkey AS ticker, s_name AS entity FROM supplier WHERE s_nationkey % 2 = 0
      UNION ALL SELECT 'C' || c_custkey, c_name FROM customer WHERE c_nationkey % 2 = 0""",
    "tickers": "SELECT 'S' || s_suppkey AS ticker FROM supplier UNION ALL SELECT 'C' || c_custkey FROM customer",
    "related": """
      SELECT s.entity AS subject, q.rel_id AS relation, o.entity AS object, q.date_wk AS time, q.source_file, coalesce(r.relation, q.rel_id) AS relation_name
      FROM quads q JOIN entities s ON s.id = q.subj_id JOIN entities o ON o.id = q.obj_id LEFT JOIN relations r ON r.id = q.rel_id
      WHERE q.date_wk BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AND s.type_name = 'COMP' AND o.type_name = 'COMP'
        AND s.entity IN (SELECT entity FROM mapping) AND o.entity IN (SELECT entity FROM mapping)""",
    "decoded": """
      SELECT coalesce(s.entity, q.subj_id) AS subject, coalesce(s.type_name, 'UNKNOWN') AS subject_type, coalesce(r.relation, q.rel_id) AS relation,
             coalesce(o.entity, q.obj_id) AS object, coalesce(o.type_name, 'UNKNOWN') AS object_type, q.date_wk AS time
      FROM quads q LEFT JOIN entities s ON s.id = q.subj_id LEFT JOIN entities o ON o.id = q.obj_id LEFT JOIN relations r ON r.id = q.rel_id""",
    "qa": """
      SELECT conv_id, turn, question, "text" AS answer FROM (
        SELECT *, lag(role) OVER w AS was, lag("text") OVER w AS question FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      WHERE role = 'assistant' AND was = 'user'""",
}
_NEEDS = {
    "days": ["bars"], "placed": ["bars"], "summaries": ["posts"], "slots": ["bars"], "moves": ["answers"], "judged": ["answers", "moves"],
    "related": ["entities", "relations", "quads", "mapping"], "decoded": ["entities", "relations", "quads"],
}


def _sql(body: str, *ctes: str, more: str = "") -> str:
    names: list[str] = []
    for c in ctes:
        names += [x for x in [*_NEEDS.get(c, []), c] if x not in names]
    head = [f"{n} AS ({_CTES[n]})" for n in names] + ([more] if more else [])
    return (f"WITH {', '.join(head)} " if head else "") + body


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _filled(template: str, **values: str) -> str:
    """A template as an SQL expression."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [_lit(before), values[name]]
    return "(" + " || ".join([*out, _lit(rest)]) + ")"


_UNINFORMATIVE = _lit(f"^(?:{text.UNINFORMATIVE})")
_METRICS = """
  SELECT {by} CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, CAST(tn + fp + fn + tp AS BIGINT) AS total,
    round(coalesce((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0.0), 9) AS accuracy,
    round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0), 9) AS precision,
    round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0), 9) AS recall,
    round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0), 9) AS f1,
    round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0.0), 9) AS mcc
  FROM (SELECT {by} count(*) FILTER (NOT a AND NOT p) AS tn, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (a AND p) AS tp
        FROM judged {where} {group})"""


def _reflect(t: str) -> str:
    return _filled(prompts.PREDICT_REFLECT, ticker="ticker", summary="summary", examples=_lit(prompts.EXAMPLES), reflections=t)


_NOTE = "('Weigh the facts anew; the trial had ' || length(" + _filled(prompts.REFLECT, ticker="ticker", scratchpad="pad") + ") || ' characters.')"
_ANSWERED = """
  SELECT *, {facts} || answer AS pad, split_part(answer, chr(10), 1) AS prediction FROM (
    SELECT *, CASE WHEN length(prompt) % 3 > 0 THEN 'Positive' ELSE 'Negative' END || chr(10) || 'Explanation: length ' || length(prompt) AS answer FROM (
      SELECT sample_id, ticker, summary, target, notes, {trial} AS trial, {prompt} AS prompt FROM ({rows})))"""
_SHOWN = "(" + _lit(prompts.REFLECTION_HEADER + "Reflections:\n- ") + " || array_to_string(notes, chr(10) || '- '))"


def _trial(n: int) -> str:
    if n == 0:
        rows = """SELECT doc_id AS sample_id, source AS ticker, "text" AS summary, CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END AS target,
                  CAST([] AS VARCHAR[]) AS notes FROM labels JOIN documents USING (doc_id)"""
        prompt = _reflect("''")
    else:
        rows = f"SELECT * REPLACE (list_append(notes, {_NOTE}) AS notes) FROM t{n - 1} WHERE prediction <> target"
        prompt = _reflect(_SHOWN)
    return f"t{n} AS (" + _ANSWERED.format(facts=_filled(prompts.FACTS_BLOCK, summary="summary"), trial=n, prompt=prompt, rows=rows) + ")"


_HISTORY = ", ".join(_trial(n) for n in range(3)) + ", history AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)"
_ENTRY = f"trim({_lit(prompts.PREDICT.partition(text.EXAMPLES_MARK)[0].partition('{ticker}')[0])} || ticker || {_lit(prompts.PREDICT.partition(text.EXAMPLES_MARK)[0].partition('{ticker}')[2])}, {_lit(chr(10) + ' ')})"


def _without_shots(reflections: str | None) -> str:
    body = (prompts.PREDICT if reflections is None else prompts.PREDICT_REFLECT).partition(text.EXAMPLES_END)[2]
    values = {"summary": "summary"} | ({} if reflections is None else {"reflections": reflections})
    tail = _filled(body, **values)
    return rf"({_ENTRY} || chr(10) || chr(10) || regexp_replace(regexp_replace({tail}, '^\s+', ''), '\s+$', ''))"


def _without_notes(summary: str) -> str:
    """What remains after the last facts mark, glued to the part before the failure mark, which is all before the notes."""
    head = _filled(prompts.PREDICT.partition("Facts:\n{summary}")[0], ticker="ticker", examples=_lit(prompts.EXAMPLES))
    tail = f"split_part({_lit(chr(10) * 2 + 'Facts:' + chr(10))} || {summary} || {_lit(chr(10) * 2 + 'Price Movement:')}, {_lit(text.FACTS_MARK)}, -1)"
    return rf"(regexp_replace({head}, '\s+$', '') || {_lit(chr(10) * 2 + 'Facts')} || regexp_replace(regexp_replace({tail}, '^\s+', ''), '\s+$', ''))"


_SHOWN_OR_NONE = f"CASE WHEN len(notes) > 0 THEN {_SHOWN} ELSE '' END"

ORACLES: dict[str, str] = {
    "sample_windows": _sql(
        rf"""SELECT ticker, date AS end_date, target, n_days, md5(s) AS summary_md5, length(s) AS summary_chars FROM (
          SELECT ticker, date, target, count(*) AS n_days,
            regexp_replace(string_agg(strftime(day, '%Y-%m-%d') || chr(10) || summary, chr(10) || chr(10) ORDER BY day), '\s+$', '') AS s
          FROM slots JOIN days USING (ticker, date) JOIN summaries USING (ticker, day)
          WHERE summary <> '' AND NOT regexp_matches(summary, {_UNINFORMATIVE}) GROUP BY ALL)""",
        "days", "slots", "summaries",
    ),
    "price_labels": _sql("SELECT * FROM days", "days"),
    "price_labels_long": _sql(
        "SELECT ticker, CASE WHEN pct > 0 THEN 'Positive' ELSE 'Negative' END AS target, count(*) AS n FROM bars_long GROUP BY ALL", "bars_long"
    ),
    "temporal_split": _sql("SELECT ticker, date, idx, n, CASE WHEN idx >= round(n * 0.8) THEN 'test' ELSE 'train' END AS split FROM placed", "placed"),
    "temporal_split_in_range": _sql(
        """SELECT ticker, CASE WHEN idx >= round(n * 0.8) THEN 'test' ELSE 'train' END AS split, count(*) AS n_days, min(date) AS first_day, max(date) AS last_day
        FROM (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY ticker) AS n
              FROM bars_long WHERE date BETWEEN DATE '1994-01-01' AND DATE '1996-01-01') GROUP BY ALL""",
        "bars_long",
    ),
    "train_head14": _sql("SELECT ticker, date, idx FROM placed WHERE idx < 14 AND idx < round(n * 0.8)", "placed"),
    "reverse_order_bars": _sql("SELECT ticker, date, idx FROM placed", "placed"),
    "date_range_inclusive": _sql("SELECT ticker, date, cents FROM bars_long WHERE date >= DATE '1994-01-01' AND date <= DATE '1996-01-01'", "bars_long"),
    "date_spine_slots": _sql(
        """SELECT s.ticker, s.date, s.day, count(p.id) AS n_posts FROM slots s LEFT JOIN posts p ON p.ticker = s.ticker AND p.date = s.day GROUP BY ALL""", "slots", "posts"
    ),
    "window_range_join": _sql(
        "SELECT b.ticker, b.date, count(*) AS n_posts FROM bars b JOIN posts p ON p.ticker = b.ticker AND p.date < b.date AND p.date >= b.date - 5 GROUP BY ALL", "bars", "posts"
    ),
    "rolling_5day_counts": _sql(
        """SELECT ticker, date, CAST(coalesce(sum(n) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 0) AS BIGINT) AS n_before
        FROM (SELECT ticker, date, count(*) AS n FROM posts GROUP BY ALL)""",
        "posts",
    ),
    "daily_posts_concat": _sql(
        """SELECT ticker, date, md5(t) AS text_md5, length(t) AS chars FROM (SELECT ticker, date, string_agg("text", chr(10) ORDER BY line_no) AS t FROM posts GROUP BY ALL)""", "posts"
    ),
    "daily_posts_array": _sql(
        """SELECT ticker, date AS day, count(*) AS n, CAST(sum(length("text")) AS BIGINT) AS chars, md5(min_by("text", line_no)) AS first_md5 FROM posts GROUP BY ALL""", "posts"
    ),
    "informative_filter": _sql(f"""SELECT id, "text" <> '' AND NOT regexp_matches("text", {_UNINFORMATIVE}) AS informative FROM posts""", "posts"),
    "distinct_day_summaries": _sql("SELECT ticker, count(*) AS n_slots, count(DISTINCT day) AS n_days FROM slots JOIN summaries USING (ticker, day) GROUP BY ALL", "slots", "summaries"),
    "summary_store_merge": _sql(
        "SELECT ticker, day, ticker >= 'p' AS is_new, md5(CASE WHEN ticker < 'p' THEN summary ELSE 'new ' || ticker END) AS summary_md5 FROM summaries", "summaries"
    ),
    "prompt_truncation": _sql(
        """SELECT ticker, date, count(*) AS n_posts FROM (SELECT *, sum(length("text")) OVER (PARTITION BY ticker, date ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS up FROM posts)
        WHERE up <= 16385 GROUP BY ALL""",
        "posts",
    ),
    "direction_extract": _sql("SELECT doc_id, prediction AS stock_movement FROM moves", "moves"),
    "first_token_prediction": r"""SELECT doc_id, md5(nullif(regexp_extract(split_part("text", 'Price Movement: ', -1), '^\s*(\S+)', 1), '')) AS token_md5 FROM documents""",
    "classification_metrics": _sql(_METRICS.format(by="", where="", group=""), "judged"),
    "metrics_empty": _sql(_METRICS.format(by="", where="WHERE doc_id < 0", group=""), "judged"),
    "per_ticker_metrics": _sql(_METRICS.format(by="lang,", where="", group="GROUP BY lang"), "judged"),
    "metrics_document": _sql(
        "SELECT 'm' AS model_name, 'd' AS dataset_name, count(*) AS total_samples, CAST(0 AS BIGINT) AS invalid_samples, count(*) FILTER (a AND p) AS tp FROM judged", "judged"
    ),
    "running_tally": _sql(
        """SELECT doc_id, lang, CAST(sum(CASE WHEN prediction = label THEN 1 ELSE 0 END) OVER w AS BIGINT) AS n_correct,
          CAST(sum(CASE WHEN prediction = label THEN 0 ELSE 1 END) OVER w AS BIGINT) AS n_incorrect
        FROM judged WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""",
        "judged",
    ),
    "pair_accuracy": "SELECT round(avg(CASE WHEN doc_id * 7919 % 1000 >= doc_id * 104729 % 1000 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM labels",
    "pair_loss": "SELECT round(avg(ln(1 + exp(-(doc_id * 7919 % 1000 / 100.0 - doc_id * 104729 % 1000 / 100.0)))), 9) AS loss FROM labels",
    "kg_relationships": _sql("SELECT * FROM related", "related"),
    "kg_relation_counts": _sql("SELECT relation, count(*) AS n FROM related GROUP BY ALL", "related"),
    "kg_type_counts": _sql(
        "SELECT 'subject' AS side, subject_type AS type, count(*) AS n FROM decoded GROUP BY ALL UNION ALL SELECT 'object', object_type, count(*) FROM decoded GROUP BY ALL", "decoded"
    ),
    "kg_year_hist": _sql("SELECT CAST(year(time) AS INTEGER) AS year, count(*) AS n FROM related GROUP BY ALL", "related"),
    "kg_dataset_stats": _sql(
        """SELECT count(*) AS n_quads, count(DISTINCT relation) AS n_relations,
          (SELECT count(*) FROM (SELECT subject FROM decoded UNION SELECT object FROM decoded)) AS n_entities FROM decoded""",
        "decoded",
    ),
    "kg_decode_fallback": _sql("SELECT * FROM decoded", "decoded"),
    "kg_unmapped": _sql("SELECT ticker FROM tickers WHERE ticker NOT IN (SELECT ticker FROM mapping)", "tickers", "mapping"),
    "kg_ticker_mapping": _sql(
        """SELECT t.ticker, CASE WHEN e.id IS NOT NULL THEN m.entity END AS entity, e.id AS entity_id FROM tickers t LEFT JOIN mapping m USING (ticker)
        LEFT JOIN (SELECT entity, max(id) AS id FROM entities GROUP BY ALL) e ON e.entity = m.entity""",
        "tickers", "mapping", "entities",
    ),
    "kg_keyword_entities": _sql("SELECT id, entity FROM entities WHERE regexp_matches(lower(entity), 'stock|share|er#00000001')", "entities"),
    "kg_company_preview": _sql(
        "SELECT id, entity, n_companies FROM (SELECT id, entity, count(*) OVER () AS n_companies FROM entities WHERE type_name = 'COMP') ORDER BY id LIMIT 10", "entities"
    ),
    "kg_lineage_counts": _sql("SELECT source_file, count(*) AS n FROM related GROUP BY ALL", "related"),
    "last_wins_dedup": "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, min(event_id) AS first_id FROM events GROUP BY ALL",
    "reflect_trials": _sql("SELECT sample_id, trial, prediction, len(notes) AS n_reflections, prediction = target AS correct FROM history", more=_HISTORY),
    "trial_summary": _sql(
        "SELECT trial, count(*) FILTER (prediction = target) AS correct, count(*) FILTER (prediction <> target) AS incorrect FROM history GROUP BY ALL", more=_HISTORY
    ),
    "preference_pairs": _sql(
        f"""SELECT sample_id, md5({_without_notes("summary")}) AS input_md5, was AS completion_a, answer AS completion_b, answer AS chosen FROM (
          SELECT *, lag(answer) OVER w AS was, lag(prediction = target) OVER w AS was_right FROM history WINDOW w AS (PARTITION BY sample_id ORDER BY trial))
        WHERE prediction = target AND NOT was_right""",
        more=_HISTORY,
    ),
    "sft_rows": _sql("SELECT sample_id, md5(prompt) AS instruction_md5, '' AS input, answer AS output FROM history WHERE trial = 0 AND prediction = target", more=_HISTORY),
    "result_rows": _sql(
        f"""SELECT md5({_without_shots(_SHOWN_OR_NONE)}) AS prompt_md5, answer AS Response, target AS Target
        FROM (SELECT *, max(trial) OVER (PARTITION BY sample_id) AS last FROM history) WHERE trial = last""",
        more=_HISTORY,
    ),
    "trial_log": _sql(
        f"""SELECT trial, md5('Correct: ' || count(*) FILTER (prediction = target) || ', Incorrect: ' || count(*) FILTER (prediction <> target) || chr(10)
          || string_agg({_without_shots(_SHOWN_OR_NONE)} || chr(10) || 'Correct answer: ' || target, chr(10) || chr(10) ORDER BY sample_id)) AS log_md5
        FROM history WHERE trial > 0 GROUP BY trial""",
        more=_HISTORY,
    ),
    "best_of_n": """SELECT doc_id, cand, doc_id || '-' || cand AS answer, score FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cand) AS rn
        FROM (SELECT doc_id, CAST(k AS INTEGER) AS cand, (doc_id * 7919 + k * 104729) % 1000 AS score FROM documents, unnest([0, 1, 2, 3]) u(k))) WHERE rn = 1""",
    "n_shot_answers": _sql(
        """SELECT sample_id, cand, answer, score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, cand) AS rn FROM (
          SELECT *, CAST(ascii(right(answer, 1)) AS INTEGER) AS score FROM (
            SELECT conv_id || '-' || turn AS sample_id, CAST(k AS INTEGER) AS cand, CAST(k AS VARCHAR) || ' ' || md5(question || chr(31) || k) AS answer
            FROM qa, unnest([0, 1, 2, 3]) u(k)))) WHERE rn = 1""",
        "qa",
    ),
    "prompt_build": f"""SELECT doc_id, md5({_filled(prompts.PREDICT, ticker="source", summary='"text"', examples=_lit(prompts.EXAMPLES))}) AS predict_md5,
        md5({_filled(prompts.PREDICT_REFLECT, ticker="source", summary='"text"', examples=_lit(prompts.EXAMPLES), reflections="'none'")}) AS reflect_md5 FROM documents""",
    "chat_messages": f"""SELECT doc_id, CAST(2 AS BIGINT) AS n, 'system,user' AS roles,
        md5({_filled(prompts.FORECAST_USER, company_description="source", summary='"text"')}) AS user_md5 FROM documents""",
    "company_profiles": f"""SELECT ticker, {_filled(prompts.COMPANY, ticker="ticker")} AS prompt, {_filled(prompts.SIMILAR, ticker="ticker")} AS similar
        FROM (SELECT DISTINCT event_type AS ticker FROM events)""",
    "reflection_bullets": rf"""SELECT conv_id, md5({_lit(prompts.REFLECTION_HEADER + "Reflections:" + chr(10) + "- ")} ||
        string_agg(regexp_replace(regexp_replace(coalesce("text", ''), '^\s+', ''), '\s+$', ''), chr(10) || '- ' ORDER BY turn)) AS bullets_md5
        FROM conversations WHERE role = 'assistant' GROUP BY ALL""",
    "remove_fewshot": f"""SELECT doc_id, md5({_without_shots(None)}) AS prompt_md5 FROM (SELECT doc_id, source AS ticker, "text" AS summary FROM documents)""",
    "remove_reflections": f"""SELECT doc_id, md5({_without_notes("summary")}) AS prompt_md5 FROM (SELECT doc_id, source AS ticker, "text" AS summary FROM documents)""",
    "sft_pairs": _sql(
        f"""SELECT conv_id, turn, md5({_filled(prompts.INSTRUCT, instruction="question")} || answer) AS sft_md5,
          md5({_filled(prompts.QUESTION, question="question")} || answer) AS qa_md5 FROM qa""",
        "qa",
    ),
    "pad_and_mask": r"""SELECT doc_id, CAST(256 AS BIGINT) AS n, CAST(coalesce(list_sum(ids[1:256]), 0) AS BIGINT) AS id_sum, least(len(ids), 256) AS n_real,
          CAST(-1000 + coalesce(list_sum(ids[11:256]), 0) AS BIGINT) AS label_sum, CAST(ceil(len(ids) / 8.0) * 8 AS BIGINT) AS rounded
        FROM (SELECT doc_id, list_transform(list_filter(string_split_regex("text", '[ \n]+'), lambda w: w <> ''), lambda w: length(w)) AS ids FROM documents)""",
    "token_length_filter": _sql(
        r"""SELECT * FROM (SELECT conv_id, turn, len(list_filter(string_split_regex('Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer, '\s+'), lambda w: w <> '')) AS n_j,
          len(list_filter(string_split_regex('Question: ' || question || chr(10) || chr(10) || 'Answer: x', '\s+'), lambda w: w <> '')) AS n_k FROM qa) WHERE n_j <= 64 AND n_k <= 64""",
        "qa",
    ),
    "train_subset_limit": _sql("SELECT conv_id, turn FROM qa ORDER BY conv_id, turn LIMIT 100", "qa"),
    "news_html_clean": rf"""SELECT page_id, md5(p) AS prompt_md5, length(p) AS chars FROM (SELECT page_id,
        {_filled(prompts.NEWS, ticker="url", news="regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ " + chr(92) + "n" + chr(92) + "t" + chr(92) + "r]+', ' ', 'g')")} AS p FROM pages)""",
    "hash_split": """SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) % 10000 < 1000 THEN 'val' ELSE 'train' END AS fold FROM documents""",
    "summary_store_roundtrip": _sql(
        "SELECT ticker, day, ticker >= 'p' AS is_new, CASE WHEN ticker >= 'p' THEN md5('new ' || ticker) WHEN day(day) % 5 <> 0 THEN md5(summary) END AS summary_md5 FROM summaries", "summaries"
    ),
    "price_files": _sql("SELECT ticker, date, round(coalesce(pct, 0), 9) AS pct_change, cents AS volume FROM bars", "bars"),
    "post_files": _sql(
        """SELECT ticker, date, row_number() OVER (PARTITION BY ticker, date ORDER BY line_no) - 1 AS line_no, id, md5("text") AS text_md5 FROM posts""", "posts"
    ),
    "kg_files": _sql("SELECT source_file, relation_name, CAST(year(time) AS INTEGER) AS year, count(*) AS n FROM related GROUP BY ALL", "related"),
    "sft_files": _sql("SELECT md5(prompt) AS instruction_md5, '' AS input, answer AS output FROM history WHERE trial = 0 AND prediction = target", more=_HISTORY),
    "preference_files": _sql(
        f"""SELECT md5({_without_notes("summary")}) AS input_md5, was AS completion_a, answer AS completion_b FROM (
          SELECT *, lag(answer) OVER w AS was, lag(prediction = target) OVER w AS was_right FROM history WINDOW w AS (PARTITION BY sample_id ORDER BY trial))
        WHERE prediction = target AND NOT was_right""",
        more=_HISTORY,
    ),
    "result_files": _sql(
        f"""SELECT md5({_without_shots(_SHOWN_OR_NONE)}) AS prompt_md5, answer AS Response, target AS Target
        FROM (SELECT *, max(trial) OVER (PARTITION BY sample_id) AS last FROM history) WHERE trial = last""",
        more=_HISTORY,
    ),
    "state_files": _sql(
        """SELECT sample_id, CAST(trial AS BIGINT) AS trial, prediction, len(notes) AS n_reflections
        FROM (SELECT *, max(trial) OVER (PARTITION BY sample_id) AS last FROM history) WHERE trial = last""",
        more=_HISTORY,
    ),
    "lenient_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS week FROM orders",
    "report_lines": """SELECT n, n || '. ' || c_name || ' #' || c_custkey AS line FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)""",
    "daily_summary_prompts": _sql(
        f"""SELECT ticker, day, md5(p) AS prompt_md5, 'Facts: ' || length(p) AS summary FROM (SELECT ticker, day,
          {_filled(prompts.SUMMARY, ticker="ticker", tweets="t", examples=_lit(prompts.SUMMARY_EXAMPLES))} AS p FROM (
          SELECT ticker, date AS day, string_agg("text", chr(10) ORDER BY line_no) AS t
          FROM posts GROUP BY ALL))""",
        "posts",
    ),
    "forecast_metrics": _sql(
        _METRICS.format(by="", where="", group="").replace(
            "FROM judged",
            rf"""FROM (SELECT target = 'Positive' AS a, length({_filled(prompts.FORECAST_USER, company_description=f"('Description: ' || md5({_filled(prompts.COMPANY, ticker='ticker')}))", summary="s")}) % 3 > 0 AS p FROM (
              SELECT ticker, date, target, regexp_replace(string_agg(strftime(day, '%Y-%m-%d') || chr(10) || summary, chr(10) || chr(10) ORDER BY day), '\s+$', '') AS s
              FROM slots JOIN days USING (ticker, date) JOIN summaries USING (ticker, day)
              WHERE summary <> '' AND NOT regexp_matches(summary, {_UNINFORMATIVE}) GROUP BY ALL))""",
        ),
        "days", "slots", "summaries",
    ),
    "pair_collate": _sql(
        r"""SELECT conv_id, turn, CAST(ceil(max(j) OVER w / 8.0) * 8 AS BIGINT) AS n_j, CAST(ceil(max(k) OVER w / 8.0) * 8 AS BIGINT) AS n_k, j AS real_j, k AS real_k FROM (
          SELECT conv_id, turn, len(list_filter(string_split_regex('Question: ' || question || chr(10) || chr(10) || 'Answer: ' || answer, '\s+'), lambda w: w <> '')) AS j,
          len(list_filter(string_split_regex('Question: ' || question || chr(10) || chr(10) || 'Answer: x', '\s+'), lambda w: w <> '')) AS k FROM qa) WINDOW w AS (PARTITION BY conv_id)""",
        "qa",
    ),
    "rl_dataset": _sql(
        r"""SELECT key, md5(q) AS query_md5, n, CAST('0x' || substr(md5('0|' || key), 1, 8) AS BIGINT) % 96 + 32 AS response_length FROM (
          SELECT key, q, len(list_filter(string_split_regex(q, '\s+'), lambda w: w <> '')) AS n FROM (
            SELECT conv_id || '-' || turn AS key, 'Question: ' || question || chr(10) || chr(10) || 'Answer: ' AS q FROM qa)) WHERE n < 64""",
        "qa",
    ),
    "stream_daily_counts": "SELECT event_type AS ticker, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL",
}
