"""DuckDB SQL of the queries that SQL can express."""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_URLS = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
      ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""

_CONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size,
    array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS words
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM patterns),
windows AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS words
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)),
found AS (SELECT doc_id, i, size, item_id FROM windows JOIN patterns USING (size, words)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS r(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items
  FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

_MIX = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS spot, md5(coalesce(text, '')) AS digest
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM docs GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS t FROM sizes),
-- The contract's own rule: share by weight, stop at three times the size, share the excess again.
rounds AS (
  SELECT 0 AS turn, source, source_size, weight, false AS capped, CAST(0 AS DOUBLE) AS level FROM sizes
  UNION ALL
  SELECT turn + 1, source, source_size, weight, capped OR weight * level2 > 3 * source_size, level2 FROM (
    SELECT *, ((SELECT t FROM total) - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())
      / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS level2 FROM rounds) WHERE turn < 40),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target
  FROM rounds WHERE turn = 40),
queued AS (
  SELECT d.*, source_size, target, pass, (pass * source_size + coalesce(before, 0) + size) / target AS finish
  FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY spot, doc_id, digest ROWS UNBOUNDED PRECEDING) - size AS before FROM docs) d
  JOIN targets t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1), (2)) AS p(pass) WHERE size > 0),
merged AS (
  SELECT *, sum(size) OVER (ORDER BY finish, spot, doc_id, digest, source, pass ROWS UNBOUNDED PRECEDING) AS sent FROM queued),
taken AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM merged WHERE sent <= (SELECT t FROM total) GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target AS target, coalesce(k.taken, 0) AS taken
FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON d.doc_id = k.doc_id"""

_VECTORS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (
  SELECT vec_id, label, v FROM vectors
  WHERE label IS NOT NULL AND len(v) > 0 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(v, lambda x: x <> 0))),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v)
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM vectors
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM parts LEFT JOIN counts USING (vec_id)"""

_NEAR = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE CAST(common AS DOUBLE) / (x.n + y.n - common) >= 0.8),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a),
classes AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS class_id FROM docs)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept
FROM classes JOIN parts USING (doc_id) LEFT JOIN counts USING (doc_id)"""

# The 256 crc32 remainders, by eight shifts each, and the crc32 of a text's UTF-8 bytes.
_CRC_TABLE = """bits AS (
  SELECT range AS i, range AS c, 0 AS turn FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, turn + 1 FROM bits WHERE turn < 8),
crc AS (SELECT list(c ORDER BY i) AS remainders FROM bits WHERE turn = 8)"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT)),
  lambda c, b: xor(remainders[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"""


_SHARDS = f"""
WITH RECURSIVE {_CRC_TABLE},
rows AS (
  SELECT doc_id, text, coalesce(source, '') AS name, source IS NULL AS missing,
    md5(concat_ws('|', '11', coalesce('=' || doc_id, '-'), coalesce('=' || source, '-'), coalesce('=' || md5(text), '-'))) AS spot
  FROM documents),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY missing, name ORDER BY spot) - 1 AS nth, count(*) OVER (PARTITION BY missing, name) AS n
  FROM rows),
parts AS (
  SELECT *, (nth + CAST('0x' || substr(md5('11:' || name), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)) / n AS part
  FROM ranks),
placed AS (SELECT *, row_number() OVER (ORDER BY part, spot) - 1 AS place, count(*) OVER () AS total FROM parts),
cut AS (SELECT *, place * 8 // total AS shard FROM placed)
SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc("coalesce(text, '')")} AS text_crc32, 'rows' AS law,
  CAST(shard AS INTEGER) AS shard, place - (shard * total + 7) // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut, crc"""

_VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
    unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
lowered AS (
  SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc("doc || ':' || run")} AS h FROM lowered, crc WHERE length(run) >= 7),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (
  SELECT word, n, length(word) AS size, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS masked,
    substr(word, 1, i - 1) || substr(word, i + 1) AS cut
  FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS n FROM gaps a JOIN gaps b USING (masked) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.cut = b.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS most FROM pairs GROUP BY a),
named AS (SELECT p.a, min(p.b) AS b FROM pairs p JOIN best ON p.a = best.a AND p.n = best.most GROUP BY p.a),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN named.b END AS form,
    CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN best ON best.a = w.word LEFT JOIN named ON named.a = w.word),
walk AS (
  SELECT word, word AS here FROM words
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.here = forms.word WHERE forms.form IS NOT NULL),
roots AS (SELECT walk.word, here AS root FROM walk JOIN forms ON walk.here = forms.word WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


def _manifest(levels: int = 7) -> str:
    """Trees of up to 16 ** levels nodes, one level at a time; a lone node goes up unchanged."""
    def leaf(text: str) -> str:
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(
            f"coalesce(CAST(strlen(CAST({f} AS VARCHAR)) AS VARCHAR) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields
        ) + ")"

    def up(name: str, first: str) -> str:
        """Levels of trees over (tree, place, digest); rows of level k name their parent's children."""
        steps = [f"{name}0 AS ({first})"]
        for k in range(levels):
            steps.append(f"""{name}{k + 1} AS (
  SELECT tree, place // 16 AS place, CASE WHEN any_value(n) = 1 THEN any_value(digest)
    ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest, (any_value(n) + 15) // 16 AS n
  FROM {name}{k} GROUP BY tree, place // 16)""")
        steps += [f"""{name}r{k} AS (
  SELECT tree, place // 16 AS place, any_value(n) AS n, list(digest ORDER BY place) AS run FROM {name}{k} GROUP BY tree, place // 16)"""
                  for k in range(levels)]
        return ",\n".join(steps)

    def fold(name: str, start: str) -> str:
        """Fold each row's node, and collect its siblings, level by level."""
        steps = [f"{name}f0 AS ({start})"]
        for k in range(levels):
            left, right = "run[1:f.place % 16]", "run[f.place % 16 + 2:]"
            steps.append(f"""{name}f{k + 1} AS (
  SELECT row_id, f.tree, f.place // 16 AS place, CASE WHEN n = 1 THEN node
    ELSE sha256(array_to_string({left}, '') || node || array_to_string({right}, '')) END AS node,
    proof || array_to_string({left}, '') || array_to_string({right}, '') AS proof
  FROM {name}f{k} f JOIN {name}r{k} r ON f.tree = r.tree AND r.place = f.place // 16)""")
        return ",\n".join(steps)

    return f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf("text")} AS leaf,
    CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 5 = 0
      THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS replacement
  FROM documents, crc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n,
    row_number() OVER () AS row_id FROM leaves),
{up("a", "SELECT tree, place, leaf AS digest, n FROM placed")},
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM a{levels}),
{up("b", "SELECT 0 AS tree, place, digest, n FROM subroots")},
{fold("a", "SELECT row_id, tree, place, coalesce(replacement, leaf) AS node, '' AS proof FROM placed")},
{fold("b", f"SELECT row_id, 0 AS tree, s.place, f.node, f.proof FROM af{levels} f JOIN subroots s USING (tree)")}
SELECT doc_id, leaf, s.digest AS subroot, top.digest AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root,
  f.node = top.digest AS verified
FROM placed p JOIN subroots s USING (tree) JOIN bf{levels} f USING (row_id), b{levels} AS top"""


ORACLE = {
    "op2_url_filter": _URLS,
    "op3_decontamination": _CONTAMINATION,
    "op7_mixing": _MIX,
    "op9_embedding_dedup": _VECTORS,
    "op10_ngram_join": _NEAR,
    "op11_sharding": _SHARDS,
    "op12_spelling_variants": _VARIANTS,
    "op13_merkle_manifest": _manifest(),
}
