"""The derived span table once more, as DuckDB common table expressions.

`raw`: all spans. `typ`: typed spans. `sp`: typed spans of sessions (with their agent).
"""

_AG = "['planner_agent','research_agent','writer_agent']"


def uuid_sql(x: str) -> str:
    h = f"md5(cast({x} as varchar))"
    return (
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12)"
    )


_EV = f"""
ev0 AS (
  SELECT event_id AS e, epoch_us(ts) AS ts, event_type AS et, value AS v,
    cast(json_extract_string(props, '$.k') AS int) AS k,
    event_id // 16 AS s, cast(event_id % 16 AS int) AS j
  FROM events),
ev1 AS (
  SELECT *, j < 5 + (s * 7) % 12 AS member, CASE
      WHEN et IN ('click','error') THEN 'tool' WHEN et = 'purchase' THEN 'agent'
      WHEN et = 'signup' AND k % 5 = 0 THEN 'graph' WHEN et = 'signup' AND k % 5 = 1 THEN 'autoflow'
      WHEN et = 'signup' AND k % 5 = 2 THEN 'autoagent' WHEN et = 'signup' THEN 'workflow'
      WHEN k % 4 < 2 THEN 'llm' WHEN k % 12 = 3 THEN 'other' ELSE 'task' END AS kind
  FROM ev0),
ev AS (
  SELECT *, cast(k AS varchar) AS kt, {_AG}[k % 3 + 1] AS ag,
    CASE WHEN member THEN 'app' || (s % 5) || '_' || {uuid_sql('s')} END AS sid,
    CASE WHEN k % 50 = 49 THEN 0 ELSE cast(round(v * 1e6) AS bigint) END AS dur,
    CASE WHEN k % 10 <> 9 THEN cast((ts // 1000000) || '.' || lpad(cast(ts % 1000000 AS varchar), 6, '0') AS double) END AS st
  FROM ev1),
evr AS (
  SELECT e, s, j, k, kt, kind, et, member, sid, ts, v, dur, st, ag,
    'sp' || e AS span,
    'tr' || (s * 2 + CASE WHEN j >= 8 THEN 1 ELSE 0 END) AS tid,
    CASE WHEN NOT member OR j = 0 THEN NULL WHEN e % 23 = 0 THEN 'gone' || e
      ELSE 'sp' || (s * 16 + (j - 1) // 2) END AS parent,
    CASE kind WHEN 'tool' THEN 'tool_' || (k % 4) || '.Tool' WHEN 'agent' THEN ag || '.agent'
      WHEN 'graph' THEN 'onboard.graph' WHEN 'autoflow' THEN 'autogen create group_topic_' || k
      WHEN 'autoagent' THEN 'autogen process WebSurfer' || (k % 2) || '_' || k || '.x'
      WHEN 'workflow' THEN 'onboard' || (k % 2) || '.workflow' WHEN 'llm' THEN 'openai.chat'
      WHEN 'task' THEN 'page_' || (k % 5) || '.task' ELSE 'http.request_' || (k % 3) END AS span_name,
    CASE WHEN s % 11 = 0 THEN 'unknown' WHEN s % 13 = 0 THEN '' ELSE 'app' || (s % 5) END AS svc,
    CASE WHEN s % 11 = 0 AND s % 2 = 0 THEN 'res_app' || (s % 3) END AS res_svc,
    CASE WHEN s % 13 = 0 THEN 'attr_app' || (s % 2) END AS attr_app,
    CASE WHEN s % 17 = 0 AND j % 4 = 1 THEN 'APP-' || (s % 3) END AS app_id,
    CASE WHEN et = 'error' THEN 'Error' WHEN kind = 'task' AND k % 19 = 0 THEN 'STATUS_CODE_ERROR'
      WHEN k % 2 = 0 THEN 'Ok' ELSE 'Unset' END AS status,
    CASE WHEN kind IN ('llm','tool') AND k % 8 = 0 THEN ' ' || ag || ' '
      WHEN kind IN ('llm','tool') AND k % 2 = 0 THEN ag
      WHEN kind = 'agent' AND k % 7 = 0 THEN 'lead_agent' END AS agent_raw,
    CASE WHEN kind = 'llm' THEN CASE WHEN k % 13 = 0 THEN '12.0' ELSE kt END END AS in_tok,
    CASE WHEN kind = 'llm' THEN cast(k * 2 AS varchar) END AS out_tok,
    CASE WHEN kind = 'llm' THEN CASE WHEN k % 17 = 0 THEN '-1' ELSE cast(k * 3 AS varchar) END END AS tot_tok,
    CASE WHEN kind = 'tool' AND NOT (s % 10 = 3 AND k % 2 = 1) THEN 'flow_' || (s % 3) END AS tool_flow,
    CASE WHEN kind = 'tool' THEN '{{"q": ' || kt || ', "tag": "t' || (k % 4) || '"}}' END AS tool_in,
    CASE WHEN kind <> 'tool' THEN NULL
      WHEN et = 'error' AND k % 2 = 0 THEN '{{"error": "Traceback (most recent call) in step ' || kt || '"}}'
      WHEN k % 20 = 6 THEN '{{"msg": {{"deep": ["ValueError Exception raised at ' || kt || '"]}}}}'
      WHEN k % 20 = 11 THEN '{{"exception": "none", "status": "clean"}}'
      WHEN k % 5 = 0 THEN '{{"result": {{"status": "ok", "code": ' || kt || '}}}}'
      WHEN k % 5 = 1 THEN '{{"status": "failed", "note": "retry ' || kt || '"}}'
      WHEN k % 5 = 2 THEN 'plain text ' || kt
      WHEN k % 5 = 3 THEN '[{{"status": "partial"}}]' END AS tool_out,
    CASE WHEN kind <> 'llm' THEN NULL WHEN k % 5 = 0 THEN '{{"next": "FINISH"}}'
      WHEN k % 5 = 1 THEN 'Assistant result for item ' || kt || ': the computed value is ' || (k * k) || '.'
      WHEN k % 5 = 2 THEN '{{"choices": [{{"logprobs": {{"content": [{{"token": "a", "logprob": -0.' || lpad(kt, 2, '0')
        || ', "bytes": null, "top_logprobs": []}}, {{"token": "b", "logprob": -1.' || lpad(cast(99 - k AS varchar), 2, '0')
        || ', "bytes": null, "top_logprobs": []}}]}}}}]}}'
      WHEN k % 5 = 3 THEN 'The word finish is mentioned.'
      ELSE 'Short analysis of item ' || kt || ' to research and write' END AS completion
  FROM ev),
evt AS (
  SELECT *,
    CASE kind WHEN 'autoflow' THEN 'workflow' WHEN 'autoagent' THEN 'agent'
      WHEN 'other' THEN CASE WHEN k % 10 = 5 THEN 'tool' END ELSE kind END AS etype,
    CASE kind WHEN 'tool' THEN CASE WHEN k % 29 = 0 THEN 'unknown' ELSE 'tool_' || (k % 4) END
      WHEN 'agent' THEN CASE WHEN k % 7 = 0 THEN 'lead_agent' WHEN k % 11 = 3 THEN 'fallback_agent' ELSE ag END
      WHEN 'autoagent' THEN 'WebSurfer' || (k % 2)
      WHEN 'llm' THEN CASE WHEN k % 9 <> 0 THEN 'model-a-1' ELSE 'unknown' END
      WHEN 'task' THEN CASE WHEN k % 6 = 2 THEN 'review_agent.task' ELSE 'page_' || (k % 5) END
      WHEN 'workflow' THEN 'flow_' || (k % 2) WHEN 'graph' THEN 'graph_main' ELSE 'unknown' END AS name,
    (et = 'error') OR (kind = 'tool' AND k % 20 = 6) OR (kind = 'task' AND k % 14 = 7) AS err
  FROM evr),
"""

_CHAT = f"""
tn AS (SELECT conv_id, turn, role, text FROM conversations),
ch0 AS (
  SELECT a.conv_id AS conv, a.turn AS call, a.text AS text0, p1.text AS text1, p.text AS second_text
  FROM tn a LEFT JOIN tn p1 ON p1.conv_id = a.conv_id AND p1.turn = a.turn - 1
    LEFT JOIN tn p ON p.conv_id = a.conv_id AND p.turn = 1
  WHERE a.role = 'assistant'),
ch AS (
  SELECT *, 'chat_' || {uuid_sql('conv')} AS sid, 'c_' || conv || '_' || call AS span, 'ctr' || conv AS tid,
    CASE WHEN call > 2 THEN 'c_' || conv || '_' || (call - 2) END AS parent,
    epoch_us(TIMESTAMP '2024-02-01 00:00:00') + conv * 60000000 + call * 1000000 AS ts,
    length(text0) * 1000000 AS dur, {_AG}[conv % 3 + 1] AS ag,
    call AS held
  FROM ch0),
cp AS (
  SELECT c.sid, c.span, c.ts, p.turn AS n, p.role AS r, p.text AS t FROM ch c JOIN tn p ON p.conv_id = c.conv AND p.turn < c.call),
"""

_TYP = """
raw AS (
  SELECT span, tid, parent, ts, sid, CASE WHEN s % 9 <> 0 THEN sid END AS sid_attr,
    CASE WHEN s % 9 = 0 THEN sid END AS exec_attr, span_name, svc, status, dur, tot_tok, 'e' AS src
  FROM evr
  UNION ALL
  SELECT span, tid, parent, ts, sid, sid, NULL, 'openai.chat', 'chat', 'Ok', dur, cast(length(text0) AS varchar), 'c'
  FROM ch),
typ AS (
  SELECT span, tid, parent, ts, sid, etype, name, err, agent_raw, st AS start_s,
    CASE WHEN dur <> 0 THEN st + dur / 1e9 END AS end_s,
    CASE WHEN dur <> 0 THEN dur / 1e6 END AS dur_ms,
    in_tok, out_tok, tot_tok, 'e' AS src, k, s, j, kind,
    coalesce(nullif(nullif(svc, ''), 'unknown'), res_svc, attr_app, 'unknown-app') AS app,
    coalesce(lower(app_id), nullif(nullif(svc, ''), 'unknown'), res_svc) AS app_cand,
    coalesce(trim(agent_raw), CASE WHEN kind = 'task' AND k % 6 = 3 THEN 'helper_agent'
      WHEN kind = 'task' AND k % 6 = 2 THEN 'review_agent' WHEN kind = 'agent' THEN name END) AS agent
  FROM evt WHERE etype IS NOT NULL
  UNION ALL
  SELECT span, tid, parent, ts, sid, 'llm', 'model-b-1', false, ag, NULL, NULL,
    CASE WHEN dur <> 0 THEN dur / 1e6 END, cast(length(text1) AS varchar), cast(length(text0) AS varchar),
    cast(length(text0) AS varchar), 'c', NULL, NULL, NULL, 'chat', 'chat', 'chat', ag
  FROM ch),
sp AS (SELECT * FROM typ WHERE sid IS NOT NULL)
"""

BASE = "WITH RECURSIVE " + _EV + _CHAT + _TYP


def with_base(body: str, *ctes: str) -> str:
    """A statement over the base expressions, with further CTEs in between."""
    more = "".join(",\n" + c for c in ctes)
    return BASE + more + "\n" + body


# Whole numbers as text, as the library reads them.
def num(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[-+]?[0-9]+$') THEN cast({c} AS bigint) END"


# Reachable spans with depth and root; ids are unique, so no loops arise here.
TREE = """tree AS (
  SELECT sid, span, tid, etype, name, ts, span AS root, tid AS root_tid, 0::BIGINT AS depth, [ts || '/' || span] AS path, [span] AS ids
  FROM sp WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM sp q WHERE q.sid = sp.sid AND q.span = sp.parent)
  UNION ALL
  SELECT c.sid, c.span, c.tid, c.etype, c.name, c.ts, t.root, t.root_tid, t.depth + 1,
    list_append(t.path, c.ts || '/' || c.span), list_append(t.ids, c.span)
  FROM sp c JOIN tree t ON c.sid = t.sid AND c.parent = t.span)"""
