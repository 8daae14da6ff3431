"""DuckDB SQL for the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

from .chat import END, NEXT, TEXT, TURN
from .mixing import CAP, SCHEDULES, SHARE, WEIGHTS
from .url_filter import DEFAULT, RULES

_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def _inverse(used: str, knots) -> str:
    """Training time at a share of the demand, for one schedule."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    cases = []
    for i, (a, b) in enumerate(zip(knots, knots[1:])):
        done = sum(areas[:i])
        left = f"({used} * {sum(areas)!r} - {done!r})"
        slope = (b[1] - a[1]) / (b[0] - a[0])
        cases.append(
            f"WHEN {used} * {sum(areas)!r} <= {done + areas[i]!r} THEN {a[0]!r} + 2 * {left} / "
            f"({a[1]!r} + sqrt(greatest(0.0::DOUBLE, {a[1] * a[1]!r} + {2 * slope!r} * {left})))"
        )
    return f"CASE {' '.join(cases)} ELSE 1.0 END"


def _position(before: str) -> str:
    used = f"({before} / target)::DOUBLE"
    kinds = " ".join(f"WHEN rank % {len(SCHEDULES)} = {i} THEN {_inverse(used, k)}" for i, k in enumerate(SCHEDULES))
    return f"round(greatest(0.0, least(1.0, CASE {kinds} END))::DOUBLE, 6)"


_rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_weights = ", ".join(map(str, WEIGHTS))
_escapes = r"len(regexp_extract_all({0}, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)'))"

ORACLES = {
    "op3_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS h FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
        FROM d WINDOW g AS (PARTITION BY h)""",
    "op4_mix_sources": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
        per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM per),
        weighed AS (SELECT *, [{_weights}][(rank % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS weight, ({CAP} * source_size)::DOUBLE AS most FROM ranked),
        filled AS (SELECT *, most / weight AS fill,
                   ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - ((sum(most) OVER f) - most))
                     / ((sum(weight) OVER ()) - (sum(weight) OVER f) + weight) AS level
                   FROM weighed WINDOW f AS (ORDER BY most / weight, rank)),
        t AS (SELECT source, source_size, rank,
              least(most, (SELECT arg_min(level, (fill, rank)) FROM filled WHERE level <= fill) * weight) AS target FROM filled),
        placed AS (SELECT doc_id, size, source_size, target, rank,
                   (sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat(doc_id::VARCHAR, ' ', size::VARCHAR)), doc_id, size
                    ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS first
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        taken AS (SELECT *, first + source_size AS second,
                  greatest(0, least(size, round(target)::BIGINT - first)) AS take_1,
                  greatest(0, least(size, round(target)::BIGINT - first - source_size)) AS take_2 FROM placed)
        SELECT doc_id, size, source_size, target, (take_1 + take_2)::BIGINT AS taken,
               CASE WHEN take_1 > 0 THEN {_position('first')} END AS position_1,
               CASE WHEN take_2 > 0 THEN {_position('second')} END AS position_2
        FROM taken""",
    "op6_chat_format": rf"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (SELECT *, role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS joined FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length(text) + {_escapes.format('text')} + CASE WHEN joined THEN {len(NEXT)}
                   ELSE {len(TURN + TEXT + END) + 1} + length(role) + {_escapes.format('role')} END)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op10_url_filter": rf"""
        WITH r(verdict, host, path) AS (VALUES {_rules}),
        rest AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
        u AS (SELECT page_id, row_number() OVER () AS n,
                     translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        m AS (SELECT u.page_id, u.n, u.host, u.path,
                     max((length(r.host) + length(r.path), length(r.host), r.verdict, r.host || r.path)) AS best
              FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
              GROUP BY ALL)
        SELECT page_id, host, path, best[4] AS rule, coalesce(best[3], '{DEFAULT}') AS verdict FROM m""",
}
