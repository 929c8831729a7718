"""The adapter views in DuckDB SQL, put before an oracle query that names them."""

from __future__ import annotations

import re

_NONBLANK = "trim(text) <> ''"
VIEWS = {
    "v_docpages": "SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no, coalesce(text, '') AS text FROM documents",
    "v_lines": f"""SELECT doc_id, page_no, pos + 1 AS ord, trim(text) AS text, 0 AS x0, 40 * (pos + 1) AS y0, 1000 AS x1, 40 * (pos + 1) + 24 AS y1, 1.0::DOUBLE AS confidence, height
      FROM (SELECT doc_id, page_no, 40 * (len(parts) + 1) AS height, unnest(parts) AS text, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, page_no, string_split(text, chr(10)) AS parts FROM v_docpages)) WHERE {_NONBLANK}""",
    "v_turns": f"""SELECT doc_id, page_no, pos + 1 AS ord, trim(text) AS text, 0 AS x0, 40 * (pos + 1) AS y0, 1000 AS x1, 40 * (pos + 1) + 24 AS y1, 1.0::DOUBLE AS confidence, height
      FROM (SELECT doc_id, page_no, 40 * (len(parts) + 1) AS height, unnest(parts) AS text, unnest(range(len(parts))) AS pos FROM (SELECT conv_id::VARCHAR AS doc_id, turn + 1 AS page_no, string_split(coalesce(text, ''), chr(10)) AS parts FROM conversations)) WHERE {_NONBLANK}""",
    "v_anchor": """SELECT l_orderkey AS doc_id, 1 + l_suppkey % 2 AS page_no, l_linenumber || '. ' || p_name AS text, (100 + 1240 * (l_partkey % 2))::INTEGER AS x0, (40 * l_quantity)::INTEGER AS y0,
      (160 + 1240 * (l_partkey % 2))::INTEGER AS x1, (40 * l_quantity + 40)::INTEGER AS y1, 1 - l_discount AS score FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_words": """SELECT doc_id, page_no, line_no, word_no, text, (20 * before + 80 * (word_no // 7))::INTEGER AS x0, (40 * line_no)::INTEGER AS y0, (20 * before + 80 * (word_no // 7) + 20 * length(text))::INTEGER AS x1,
      (40 * line_no + 24)::INTEGER AS y1, 1 - (length(text) % 10) / 20.0::DOUBLE AS confidence, height FROM
      (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY word_no) - length(text) - 1 AS before FROM
       (SELECT doc_id, page_no, ord AS line_no, height, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS word_no FROM v_lines)) WHERE text <> ''""",
    "v_cells": """SELECT *, 't' || doc_id AS table_id, max(row + 1) OVER (PARTITION BY doc_id) AS n_rows, 3 AS n_cols FROM (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS row, l_suppkey % 3 AS col,
      max_by(CASE WHEN l_returnflag = 'R' THEN '' ELSE p_name END, (l_partkey, l_suppkey, l_shipdate)) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)""",
    "v_formulas": """SELECT 'b' || p_partkey AS block_id, p_partkey, p_size, CASE WHEN p_size % 6 = 0 THEN 'chem_equation' ELSE 'equation' END AS block_type, CASE p_size % 6
      WHEN 0 THEN p_size || ' H2 + O2 -> ' || p_size || ' H2O' WHEN 1 THEN 'x**2 +  y^2 = ' || p_size || '^2' WHEN 2 THEN '  ' WHEN 3 THEN '다음 자료 ' || p_name
      WHEN 4 THEN '[Fe(H2O)4Br2]* 6H,0(1) Na' || p_size || '+(aq)' ELSE 'sqrt(' || p_size || ') plain ' || p_name END AS text FROM part""",
    "v_answers": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, k) AS ord, text FROM (
      SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, l_quantity, unnest([0, 1]) AS k, unnest([CASE WHEN l_partkey % 3 = 0 THEN l_linenumber || '.' ELSE l_linenumber || '. ' || p_brand END, p_name]) AS text
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 4 <> 0)""",
    "v_expected": "SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS question_no FROM lineitem UNION ALL SELECT l_orderkey, max(l_linenumber) + 1 FROM lineitem GROUP BY 1",
    "v_issues": """SELECT event_id % 50 AS doc_id, event_id AS ord, CASE WHEN event_id % 7 <> 0 THEN user_id % 20 END AS question_no, CASE event_type WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS severity,
      event_type AS category, 'message ' || json_extract_string(props, '$.k') AS message, 'asset_' || json_extract_string(props, '$.k') AS asset FROM events""",
    "v_items": """SELECT doc_id, question_no, row_number() OVER (PARTITION BY doc_id, question_no ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ord, type, content, target FROM (
      SELECT l_orderkey AS doc_id, (1 + l_linenumber % 4 + CASE WHEN l_linenumber % 4 = 3 THEN 1 ELSE 0 END)::INTEGER AS question_no, ['text', 'equation', 'chem_equation', 'image', 'table', 'drawing'][p_size % 6 + 1] AS type, p_name AS content,
      CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '2 H2 -> H4' WHEN 2 THEN 'a = b' ELSE p_brand END AS target, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)""",
}
#: Views that several others read: worked out once.
ONCE = {"v_answers", "v_expected", "v_heads", "v_spans_all", "v_spans", "v_notes"}


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """sql with the views it names, and those they name, as common table expressions before it."""
    known = VIEWS | (more or {})
    wanted: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if re.search(rf"\b{name}\b", text) and name not in wanted:
                add(known[name])
                if name not in wanted:
                    wanted.append(name)

    add(sql)
    heads = ", ".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({known[n]})" for n in wanted)
    if not heads:
        return sql
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads} {body}"
