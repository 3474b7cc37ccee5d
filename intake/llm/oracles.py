"""SQL (DuckDB) that gives the rows of the manifest and of the spelling variants."""

from __future__ import annotations

#: CRC-32 of a text of ASCII as a fold over its bytes; its table is made by the polynomial.
_TABLE = """crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def _crc32(octets: str) -> str:
    """Unsigned CRC-32 of a list of bytes, with ``crc.t`` in scope."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _levels(name: str, start: str, key: str, levels: int) -> list[str]:
    """CTEs ``{name}0`` .. of the nodes of every level, with the siblings of each to the left and right."""
    found = [f"{name}0 AS ({start})"]
    for k in range(levels):
        run = f"OVER (PARTITION BY {key}, slot // 16 ORDER BY slot ROWS BETWEEN"
        found.append(f"{name}{k}s AS (SELECT *, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {name}{k})")
        found.append(f"{name}{k + 1} AS (SELECT {key}, slot // 16 AS slot, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY slot)) END AS d FROM {name}{k}s GROUP BY {key}, slot // 16)")
    return found


def manifest_sql(levels: int = 6, source_levels: int = 3) -> str:
    """The manifest, for up to 16^levels rows of a source and 16^source_levels sources."""

    def leaf(text: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END" for c in fields) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [_TABLE, f"docs AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS key, {leaf('text')} AS d, CASE WHEN {_crc32("list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)")} % 5 = 0 THEN {leaf(lower)} END AS tampered FROM documents, crc)"]
    ctes.append("leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, d) - 1 AS slot FROM docs)")
    ctes += _levels("n", "SELECT key, slot, d FROM leaves", "key", levels)
    ctes += _levels("s", f"SELECT 0 AS k, row_number() OVER (ORDER BY key) - 1 AS slot, d, key FROM n{levels}", "k", source_levels)
    joins, l, r = [], [], []
    for k in range(levels):
        joins.append(f"JOIN n{k}s a{k} ON a{k}.key = leaves.key AND a{k}.slot = leaves.slot // {16**k}")
        l.append(f"CASE WHEN a{k}.n > 1 THEN a{k}.l ELSE '' END"), r.append(f"CASE WHEN a{k}.n > 1 THEN a{k}.r ELSE '' END")
    single = [f"a{k}.n = 1" for k in range(levels)]
    joins.append("JOIN s0 ON s0.key = leaves.key")
    for k in range(source_levels):
        joins.append(f"JOIN s{k}s b{k} ON b{k}.slot = s0.slot // {16**k}")
        l.append(f"CASE WHEN b{k}.n > 1 THEN b{k}.l ELSE '' END"), r.append(f"CASE WHEN b{k}.n > 1 THEN b{k}.r ELSE '' END")
        single.append(f"b{k}.n = 1")
    fold = "f0"
    steps = ["coalesce(leaves.tampered, leaves.d) AS f0"]
    for k, (a, b, one) in enumerate(zip(l, r, single)):
        steps.append(f"CASE WHEN {one} THEN {fold} ELSE sha256({a} || {fold} || {b}) END AS f{k + 1}")
        fold = f"f{k + 1}"
    proof = "sha256(" + " || ".join(f"{a} || {b}" for a, b in zip(l, r)) + ")"
    root = f"(SELECT d FROM s{source_levels})"
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (SELECT leaves.doc_id, leaves.d AS leaf, s0.d AS subroot, {root} AS root, {proof} AS proof_sha256, {', '.join(steps)}, {fold} AS folded_root FROM leaves {' '.join(joins)})"


def variants_sql() -> str:
    """The spelling variants. Letters beyond a-z are mapped to other characters of one byte, as DuckDB's distance is over bytes."""
    beyond = "".join(map(chr, range(0xC0, 0x100)))
    spare = "".join(chr(c) for c in range(33, 127) if not chr(c).islower())[: len(beyond)].replace("'", "''")
    octets = "list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)"
    return f"""WITH RECURSIVE {_TABLE},
runs AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, c, {_crc32(octets)} AS h FROM runs, crc),
shorter AS (SELECT c, CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n, translate(word, '{beyond}', '{spare}') AS w, length(word) AS k FROM shorter WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
pairs AS MATERIALIZED (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM words a JOIN words b ON a.k = b.k AND a.word < b.word WHERE levenshtein(a.w, b.w) = 1 UNION ALL SELECT a.word, a.n, b.word, b.n FROM words a JOIN words b ON a.k = b.k - 1 WHERE levenshtein(a.w, b.w) = 1),
near AS MATERIALIZED (SELECT a AS word, b AS near, bn AS near_n FROM pairs UNION ALL SELECT b, a, an FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN ranked ON ranked.word = w.word AND r = 1),
ways AS (SELECT word, word AS top FROM formed UNION ALL SELECT ways.word, form FROM ways JOIN formed ON formed.word = ways.top WHERE form IS NOT NULL)
SELECT formed.word, n, n_near, form, form_n, top AS root FROM formed JOIN ways ON ways.word = formed.word WHERE top IN (SELECT word FROM formed WHERE form IS NULL)"""
