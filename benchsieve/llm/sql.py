"""SQL for the manifest and the spelling variants, over the same tables."""

from benchsieve.llm import op11_variants, op12_merkle

#: The CRC-32 table by its rule: each of 256 entries from eight shifts.
_CRC = """
    crc_table AS MATERIALIZED (
      SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def crc32(text: str) -> str:
    """CRC-32 of a string column's UTF-8 bytes; the query must read ``crc_table``."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), {step}), 4294967295)"


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({text})) || ':' || {text} END"


def manifest_sql() -> str:
    head = " || ".join(_field(c) for c in op12_merkle.FIELDS[:-1])
    fan = op12_merkle.FAN
    run = "string_agg(digest, '' ORDER BY slot)"
    return f"""
    WITH RECURSIVE {_CRC},
    marked AS (
      SELECT *, row_number() OVER () AS id, {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS tampered
      FROM documents, crc_table),
    leaves AS (
      SELECT id, doc_id, coalesce('=' || source, '') AS tree,
             sha256({head} || {_field("text")}) AS leaf,
             sha256({head} || CASE WHEN tampered AND text IS NOT NULL
               THEN octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '')
               ELSE {_field("text")} END) AS claimed
      FROM marked),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot FROM leaves),
    nodes(tree, level, slot, digest, n) AS (
      SELECT tree, 0, slot, leaf, count(*) OVER (PARTITION BY tree) FROM placed
      UNION ALL
      SELECT tree, level + 1, slot // {fan}, sha256({run}), (any_value(n) + {fan - 1}) // {fan}
      FROM nodes WHERE n > 1 GROUP BY tree, level, slot // {fan}),
    subroots AS (
      SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS slot FROM nodes WHERE n = 1),
    tops(level, slot, digest, n) AS (
      SELECT 0, slot, subroot, count(*) OVER () FROM subroots
      UNION ALL
      SELECT level + 1, slot // {fan}, sha256({run}), (any_value(n) + {fan - 1}) // {fan}
      FROM tops WHERE n > 1 GROUP BY level, slot // {fan}),
    all_nodes AS (SELECT * FROM nodes UNION ALL SELECT NULL, level, slot, digest, n FROM tops),
    siblings AS (
      SELECT a.tree, a.level, a.slot,
             coalesce(string_agg(b.digest, '' ORDER BY b.slot) FILTER (b.slot < a.slot), '') AS before,
             coalesce(string_agg(b.digest, '' ORDER BY b.slot) FILTER (b.slot > a.slot), '') AS behind
      FROM all_nodes a JOIN all_nodes b
        ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.slot // {fan} = b.slot // {fan}
      WHERE a.n > 1 GROUP BY a.tree, a.level, a.slot),
    inner_path AS (
      SELECT p.id, list(struct_pack(l := s.before, r := s.behind) ORDER BY s.level) AS path
      FROM placed p JOIN siblings s
        ON s.tree = p.tree AND s.slot = p.slot // CAST(pow({fan}, s.level) AS BIGINT)
      GROUP BY p.id),
    outer_path AS (
      SELECT u.tree, list(struct_pack(l := s.before, r := s.behind) ORDER BY s.level) AS path
      FROM subroots u JOIN siblings s
        ON s.tree IS NULL AND s.slot = u.slot // CAST(pow({fan}, s.level) AS BIGINT)
      GROUP BY u.tree),
    proofs AS (
      SELECT p.doc_id, p.leaf, p.claimed, u.subroot,
             coalesce(i.path, []) || coalesce(o.path, []) AS path
      FROM placed p JOIN subroots u ON u.tree = p.tree
        LEFT JOIN inner_path i ON i.id = p.id LEFT JOIN outer_path o ON o.tree = p.tree),
    folded AS (
      SELECT doc_id, leaf, subroot,
             sha256(list_aggregate(list_prepend('', list_transform(path, lambda x: x.l || x.r)), 'string_agg', ''))
               AS proof_sha256,
             list_reduce(list_prepend(struct_pack(l := claimed, r := ''), path),
               lambda d, x: struct_pack(l := sha256(x.l || d.l || x.r), r := '')).l AS folded_root
      FROM proofs)
    SELECT doc_id, leaf, subroot, digest AS root, proof_sha256, folded_root, folded_root = digest AS verified
    FROM folded, (SELECT digest FROM tops WHERE n = 1)"""


def variants_sql() -> str:
    lower = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    edit = f"h % {op11_variants.MISSPELT} = 0"
    place = "CAST(h % length(run) AS BIGINT)"
    return f"""
    WITH RECURSIVE {_CRC},
    found AS (
      SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    runs AS (SELECT doc_id, {lower} AS run, count(*) AS times FROM found GROUP BY ALL),
    keyed AS (SELECT run, times, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM runs),
    hashed AS (SELECT run, times, {crc32("key")} AS h FROM keyed, crc_table),
    spelt AS (
      SELECT CASE WHEN {edit} THEN substr(run, 1, {place}) || substr(run, {place} + 2) ELSE run END AS word, times
      FROM hashed),
    counted AS MATERIALIZED (
      SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelt
      WHERE length(word) >= {op11_variants.LEAST_LETTERS} GROUP BY word
      HAVING sum(times) >= {op11_variants.LEAST_COUNT}),
    cut AS (
      SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, n, unnest(range(length(word))) AS i FROM counted)),
    pairs AS (
      SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b
        ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cut a JOIN counted b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM cut a JOIN counted b ON a.rest = b.word),
    ranked AS (
      SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
             row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
    joined AS (
      SELECT c.word, c.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN near_n >= {op11_variants.TIMES} * c.n THEN near END AS form,
             CASE WHEN near_n >= {op11_variants.TIMES} * c.n THEN near_n END AS form_n
      FROM counted c LEFT JOIN ranked r ON r.word = c.word AND r.place = 1),
    chains(word, slot) AS (
      SELECT word, word FROM joined
      UNION ALL SELECT c.word, j.form FROM chains c JOIN joined j ON j.word = c.slot WHERE j.form IS NOT NULL),
    ends AS (SELECT c.word, c.slot AS root FROM chains c JOIN joined j ON j.word = c.slot WHERE j.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM joined JOIN ends USING (word)"""
