"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from gridloom.llm.license_scan import HINT, RULES, SENTENCES, WIDER
from gridloom.llm.queries import HOSTILE

EXACT = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS kept, text_sha256 FROM d
"""



def _length(x: str) -> str:
    """Code points of an escaped text: one more for each backslash and each control string."""
    starts = r"regexp_extract_all({x}, '<\||</?s>|</?SYS>>|\[/?INST\]')".format(x=x)
    return f"length({x}) + length({x}) - length(replace({x}, '\\', '')) + len({starts})"


_HOSTILE = HOSTILE.replace("'", "''")
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{_HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{_HOSTILE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(23 + {_length('r')} + {_length('t')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licenses() -> str:
    """Pieces by position; known sentences as runs of pieces, the longest first; then each
    rule on what the rules before have left of the joined identifiers."""
    normal = r"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    cut = r"regexp_replace({x}, '([.!?;:])\s+', '\1' || chr(1), 'g')"
    hard, soft = f"replace({cut.format(x='text')}, chr(10), chr(1))", rf"regexp_replace({cut.format(x='text')}, '\n[ \t\r]*\n', chr(1), 'g')"
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in SENTENCES.items())
    pieces = "list_transform(string_split({cut}, chr(1)), lambda x: {normal})"

    def reading(name: str, at: str) -> str:
        listed = pieces.format(cut=at, normal=normal.format(x="x"))
        return f"""{name}_pieces AS (SELECT doc_id, {listed} AS p FROM hinted),
{name}_at AS (SELECT doc_id, pos, array_to_string(p[pos:pos + n - 1], '|') AS key, n FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS pos FROM {name}_pieces), (SELECT DISTINCT n FROM known) WHERE pos + n - 1 <= len(p)),
{name}_ids AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM (SELECT doc_id, pos, arg_max(id, known.n) AS id FROM {name}_at JOIN known USING (key) GROUP BY doc_id, pos) GROUP BY doc_id)"""

    def matched(name: str, of: str) -> str:
        steps, left = [f"array_to_string(list_transform({of}, lambda x: '<' || x || '>'), '') AS {name}0"], f"{name}0"
        for k, (_, ids) in enumerate(RULES, 1):
            rule = "".join(f"<{i}>" for i in ids)
            steps += [f"contains({left}, '{rule}') AS {name}_hit{k}", f"replace({left}, '{rule}', '|') AS {name}{k}"]
            left = f"{name}{k}"
        hits = ", ".join(f"CASE WHEN {name}_hit{k} THEN '{n}' END" for k, (n, _) in enumerate(RULES, 1))
        return ", ".join(steps) + f", list_distinct([x FOR x IN [{hits}] IF x IS NOT NULL]) AS {name}_names"

    within = " ".join(f"WHEN x = '{n}' THEN len(list_intersect(s_names || o_names, {over!r})) = 0" for n, over in WIDER.items() if over)
    return rf"""
WITH known AS (SELECT id, array_to_string(p, '|') AS key, len(p) AS n FROM (SELECT id, {pieces.format(cut=cut.format(x='sentence'), normal=normal.format(x='x'))} AS p FROM (VALUES {known}) AS k(id, sentence))),
hinted AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, {_quoted(HINT)})),
{reading('h', hard)},
{reading('s', soft)},
both_ AS (SELECT d.doc_id, coalesce(h.ids, []) AS hard, coalesce(s.ids, []) AS soft FROM documents d LEFT JOIN h_ids h USING (doc_id) LEFT JOIN s_ids s USING (doc_id)),
shown AS (SELECT doc_id, CASE WHEN len(soft) > len(hard) THEN soft ELSE hard END AS ids, CASE WHEN len(soft) > len(hard) THEN hard ELSE soft END AS other FROM both_),
named AS (SELECT doc_id, ids, {matched('s', 'ids')}, {matched('o', 'other')} FROM shown)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentences,
       array_to_string(list_sort(list_distinct(s_names || [x FOR x IN o_names IF CASE {within} ELSE true END])), ',') AS licenses FROM named
"""


ORACLES = {"op4_exact_dedup": EXACT, "op5_chat_tree": CHAT, "op8_license_scan": licenses()}
