"""Operators against brute force, edge cases and held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check_oracles import TABLES, rows_of
from ledgerloom.llm import (
    common,
    decontaminate,
    embedding_dedup,
    html_text,
    language_id,
    license_scan,
    mixing,
    ngram_join,
    pii,
    token_coder,
    token_output,
    url_filter,
)

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


LONG = "the cat sat on a mat and ran " * 20_000
EDGE = [
    (1, None, None, None),
    (2, "", "en", "s1"),
    (3, "### \n!!", "en", "s1"),
    (4, "Under the GNU General Public License; CC BY or MIT license.", "en", None),
    (4, "Under the GNU General Public License; CC BY or MIT license.", "en", None),
    (None, "another text of seven words is here", "en", "s2"),
    (None, "another text of seven words is here", "en", "s2"),
    (5, LONG, "en", "s2"),
    (6, "caf\u00e9 \u65e5\u672c \U0001f600 mail a@b.co end <|endoftext|>", "fr", "s2"),
    (7, "Another TEXT of seven words is: here", None, "s1"),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string").repartition(3)
    # Names that the operators use themselves.
    clash = ["n_words", "size", "class", "sketch", "component", "score", "held_out", "__key", "_at", "path", "node", "copies"]
    return df.withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.filter("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "seven words is here"), (2, None), (3, ""), (3, "sat on a mat")], "item_id long, text string")


def collected(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & {q for q in entry.queries() if re.match(r"op\d", q)}))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    got, want = df.collect(), result.fetchall()
    if name == "op7_mixing":  # the water level and the repeated sharing differ in the last digits
        at = columns.index("target")
        got = [tuple(round(r[c], 3) if c == "target" else r[c] for c in df.columns) for r in got]
        want = [tuple(round(v, 3) if i == at else v for i, v in enumerate(r)) for r in want]
    assert rows_of(df.columns, got) == rows_of(columns, want)


def test_licenses_equal_brute_force(spark, documents):
    found = {r["doc_id"]: r for r in collected(license_scan.scan_licenses(spark.read.parquet(f"{SF}/documents.parquet")))}
    for doc_id, text, _ in documents:
        places, row = license_scan.brute_places(text), found[doc_id]
        assert row["n_base"] == len(places) and row["n_words"] == len(WORD.findall(lowered(text)))
        assert row["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert row["first_word"] == min((s for s, _ in places), default=None)
        assert row["last_word"] == max((s for s, _ in places), default=None)
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
    assert any(r["n_base"] for r in found.values())


def test_license_templates_and_overlaps():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    places, spans = scanner.scan(license_scan.words_of("x " + license_scan.TEMPLATES["isc"] + " y"))
    assert [(s[0], s[1], s[3]) for s in spans if s[3] > 0.6] == [("isc", 1, 1.0)] and not places
    cut = license_scan.TEMPLATES["mit"].split()
    _, spans = scanner.scan(license_scan.words_of(" ".join(cut[:20] + ["CHANGED"] + cut[21:])))
    assert len([s for s in spans if s[0] == "mit"]) == 1 and max(s[3] for s in spans) > 0.9
    text = "mit license mit license gnu general gnu general public license cc by cc by"
    assert sorted(scanner.scan(license_scan.words_of(text))[0]) == sorted(license_scan.brute_places(text))


def test_automaton_statistics_equal_brute_force():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 3, 30).tolist() for _ in range(4)]
    automaton = license_scan.Automaton()
    for i, s in enumerate(sequences):
        automaton.add(s, i)
    automaton.finish()
    for s in sequences:
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                state = 0
                for t in s[a:b]:
                    state = automaton.next[state][t]
                want = {(j, e) for j, r in enumerate(sequences) for e in range(b - a - 1, len(r)) if r[e - b + a + 1 : e + 1] == s[a:b]}
                assert automaton.ends[state] == want


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://net", "http://net/", "HTTP://A.Example.NET/en/x?y#z", "http://example.net/EN/", "x://org/fr/",
            "x://a.org#f/fr/", "x://notexample.com/de/", "x://example.com/de/q", "http://a.net\n/x", "x://fr.org/fr/a/b", "x://.net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in collected(url_filter.judge_urls(pages, url_filter.rules_frame(spark, url_filter.RULES)))}
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lowered(m[1]), m[2]) if m else ("", "")
        fit = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        want = (host, path, best and best[0] + best[1], best[2] if best else "allow")
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == want, url
    none = url_filter.judge_urls(pages, url_filter.rules_frame(spark, []))
    assert none.filter("rule is null and verdict = 'allow'").count() == len(urls)


def test_contamination_slices_and_short_items(spark, edge, benchmark):
    one = decontaminate.find_contamination(edge, benchmark)
    many = decontaminate.find_contamination(edge, benchmark, slice_bytes=40)
    assert rows_of(one.columns, one.collect()) == rows_of(many.columns, many.collect())
    rows = [r for r in collected(one) if r["doc_id"] in (5, 7)]
    assert {(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows} == {(5, 80_000, 1, True), (7, 4, 1, True)}
    kept = [decontaminate.keep_clean(edge, benchmark, s) for s in (1 << 20, 40)]
    assert all(sorted(str(r["doc_id"]) for r in k.collect()) == ["1", "2", "3", "4", "4", "6"] for k in kept)
    assert kept[0].columns == edge.columns


def test_contamination_random_words_equal_brute_force():
    rng = np.random.default_rng(5)
    items = [(str(i), " ".join(rng.choice(list("abc"), n)).encode()) for i, n in enumerate([1, 2, 3, 5, 7, 9, 13, 14, 20])]
    patterns = decontaminate.compile_patterns(items[2:])
    for _ in range(60):
        words = [w.encode() for w in rng.choice(list("abc"), 200)]
        hit, named = set(), set()
        for item, text in items[2:]:
            w = text.split()
            size = min(13, len(w))
            for i in range(len(w) - size + 1):
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == w[i : i + size]:
                        hit |= set(range(j, j + size))
                        named.add(item)
        spans, found = decontaminate._search(patterns, words)
        assert {p for a, b in spans for p in range(a, b)} == hit and found == named


@pytest.mark.parametrize("ids", [[], [5], [9] * 5000, list(range(700)), "random", "text"])
def test_coder_round_trip(ids):
    if isinstance(ids, str) and ids == "random":
        ids = np.random.default_rng(1).integers(0, 1 << 32, 3000)
    elif isinstance(ids, str):
        ids = np.random.default_rng(1).zipf(1.3, 300_000) % 5000
    ids = np.array(ids, np.uint32)
    data = token_coder.encode(ids)
    assert np.array_equal(token_coder.decode(data), ids)
    if len(np.unique(ids)) > 1000:
        broken = bytearray(data)
        broken[-len(data) // 4] ^= 255
        with pytest.raises(ValueError):
            token_coder.decode(bytes(broken))


def test_coder_segments_of_many_ids(monkeypatch):
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.3, 60_001) % 3000).astype(np.uint32)
    monkeypatch.setattr(token_coder, "_ALPHABET", 500)
    assert np.array_equal(token_coder.decode(token_coder.encode(ids)), ids)


def test_coder_needs_less_than_order_0():
    """Ids with repeated pairs take fewer bits than their frequencies alone allow."""
    rng = np.random.default_rng(6)
    pairs = rng.integers(0, 400, (300, 2))
    ids = pairs[np.minimum(rng.geometric(0.03, 300_000) - 1, 299)].reshape(-1).astype(np.uint32)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert len(token_coder.encode(ids)) * 8 < len(ids) * -(share * np.log2(share)).sum()


def expected_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_the_tokenizer(spark, documents):
    df = token_output.token_rows(spark.read.parquet(f"{SF}/documents.parquet"), TOKENIZER)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect())
    assert got == expected_tokens([(d, t) for d, t, _ in documents])


def test_token_files_edge(spark, edge, nothing, monkeypatch):
    monkeypatch.setattr(token_output, "PARTITION_BYTES", 20_000)
    got = [tuple(r) for r in token_output.token_rows(edge, TOKENIZER).collect()]
    want = expected_tokens([(d, t) for d, t, *_ in EDGE])
    assert Counter(got) == Counter(want)
    assert token_output.token_rows(nothing, TOKENIZER).count() == 0


def test_words_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(token_output, "CACHED_WORDS", 40)
    monkeypatch.setattr(token_output, "CACHED_CHARACTERS", 300)
    encoder = token_output.WordEncoder(TOKENIZER)
    rng = np.random.default_rng(3)
    alphabet = list("abtsrelm019 '_.,!<>|\t\n\r\x20") + ["'s", "'LL", "É", "ß", "ÿ", "×", "\u0301", "日", "\x7f", "\x1c", " the "]
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 400)] + ["word " * 50, "x" * 5000]
    want = [encoder.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [x.tolist() for text in texts * 2 for x in encoder.encode([text])] == want * 2
    monkeypatch.setattr(token_output, "GROUP_CHARACTERS", 100)
    assert [x.tolist() for x in encoder.encode([None, "", *texts])] == [[], [], *want]


def base_spans(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            out += [(kind, m.start(), m.end())] if ok else []
    return out


def test_personal_data_equals_brute_force(spark, documents):
    found = {r["doc_id"]: r for r in collected(pii.find_personal_data(spark.read.parquet(f"{SF}/documents.parquet")))}
    for doc_id, text, _ in documents:
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text))
        assert found[doc_id]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_personal_data_random_characters():
    machine, rng = pii.anchors(), np.random.default_rng(9)
    for alphabet in ("a@.b-1", "0123456789. -", "+1 ().2-", "1.2@a%+ "):
        for _ in range(3000):
            text = "".join(rng.choice(list(alphabet), 40))
            spans = pii.find_spans(text, machine)
            assert [s for s in spans if s[0] in pii.KINDS] == base_spans(text), text
    text = "IBAN: DE89 3704 0044 0532 0130 00, see https://me:secret@host.example/x"
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text, machine) if k in pii.MORE] == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("login", "me:secret")]


def test_main_text():
    page = (
        "<html><head><title>T</title><script>if (a<b) x('</p>')</script></head><body class='has-sidebar'><header><h2>Site</h2></header>"
        "<nav><ul><li>Home<li>About</ul></nav><div class=\"ad\">Buy</div><article><h1>Head &amp; line</h1><p><b>First\n  para<br>"
        "<p>Short.</p><aside>Aside</aside><div id=promo-box>Buy <p>now</p></div><p>A <i>last</i>&nbsp;one &lt;3</p>"
        "<section class='reader comments'><p>I agree with everything in this text, really all of it.</p></section></article>"
        "<form>Mail <input></form><footer>&copy; x</footer></body></html>"
    )
    assert html_text.main_text(page) == "Head & line\nFirst para\nShort.\nA last one <3"
    assert [html_text.main_text(h) for h in (None, "", "<p", "plain text", "<nav>x")] == ["", "", "", "plain text", ""]
    unmarked = "<div class=menu>a b</div><div><p>" + "long text " * 30 + "<p>tail</div><div class=footer>end</div>"
    assert html_text.main_text(unmarked) == ("long text " * 30).strip() + "\ntail"


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_main_text_of_an_unmarked_page_with_adverts(depth):
    ad, body = "<div class=ad>Buy this</div>", "<p>" + "long text " * 80 + "</p>"
    page = f"<nav>Home</nav><div><h1>Title</h1></div>{ad}{body}{ad}<p>Short.</p>{ad}<h2>Close</h2><p>The end.</p><footer>x</footer>"
    page = "<html><body>" + "<div class=outer>" * depth + page + "</div>" * depth + "</body></html>"
    want = ["Title", ("long text " * 80).strip(), "Short.", "Close", "The end."]
    assert html_text.main_text(page) == "\n".join(want)
    wrapped = page.replace(body, f"<div>{body}</div>")
    assert html_text.main_text(wrapped) == "\n".join(want)


def test_main_text_keeps_article_text_with_cue_words():
    page = (
        "<article role=main><h1 class=page-header>On search</h1><p class=notice-text>A <mark class=\"search-hit\">word</mark> and a "
        "<a class=share href=x>link</a>.</p><h2 id=\"related-work\">Related work</h2><section id=\"social-effects\"><p>Effects.</p>"
        "</section><section id=search><p>Searching.</p></section><div class='social-norms study'>Norms.</div>"
        "<div class='x shareButtons'>Share</div><ul class='related-posts'><li>Other</ul><aside>Aside</aside>"
        "<section class=comments>No.</section><div id=promo-box>Buy</div><div role=search>Find</div></article><p class=ad>Ad</p>"
    )
    want = ["On search", "A word and a link.", "Related work", "Effects.", "Searching.", "Norms."]
    assert html_text.main_text(page) == "\n".join(want)


def test_pages_keep_their_article(spark):
    rows = collected(html_text.extract_text(spark.read.parquet(f"{SF}/pages.parquet")))
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for row in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[row["page_id"]], re.S)[1]
        from html import unescape

        want = [" ".join(unescape(re.sub(r"<[^>]*>|<[^>]*\Z", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert row["text"] == "\n".join(w for w in want if w) and row["n_chars"] == len(row["text"])


def test_mix(spark, edge, nothing):
    rows = collected(mixing.mix_sources(edge))
    assert len(rows) == len(EDGE) and mixing.mix_sources(nothing).count() == 0
    assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mix_sources(docs)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in collected(mixed):
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert rows_of(mixed.columns, mixed.collect()) == rows_of(mixed.columns, again)
    copies = Counter({r["doc_id"]: r["copies"] for r in collected(mixed) if r["copies"]})
    whole = mixing.mixed_documents(docs)
    assert Counter(r["doc_id"] for r in whole.select("doc_id").collect()) == copies and whole.columns == docs.columns
    repeated = mixing.mixed_documents(edge)
    assert repeated.count() == sum(r["copies"] for r in rows) and repeated.columns == edge.columns


def test_targets_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 10), (None, 0), ("c", 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 700.0, "b": 30.0, "c": 270.0, None: 0.0}


def test_languages_held_out(spark, documents, edge, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in collected(language_id.predict_languages(docs, language_id.train(docs)))}
    mine = [(rows[d], lang) for d, _, lang in documents if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in mine) and sum(r["held_out"] for r in rows.values()) == len(mine)
    assert np.mean([r["lang_pred"] == lang for r, lang in mine]) > 0.97
    model = language_id.train(docs)
    found = Counter((r["doc_id"], r["lang_pred"]) for r in collected(language_id.predict_languages(edge, model)))
    assert found[(1, "und")] == found[(2, "und")] == found[(3, "und")] == 1 and found[(5, "en")] == 1
    assert {r["doc_id"] for r in language_id.keep_identified(edge, model).collect()}.isdisjoint({1, 2, 3})
    assert language_id.train(nothing) is None and language_id.predict_languages(nothing, None).count() == 0


def test_language_pieces_do_not_matter(monkeypatch):
    texts = ["Eins zwei drei", None, "quatre cinq", "", "x" * 50]
    codes, starts = language_id.codes_of(texts)
    whole = language_id.buckets_of(codes, 3, 1 << 15, 0, len(codes))
    parts = [language_id.buckets_of(codes, 3, 1 << 15, a, min(a + 7, len(codes))) for a in range(0, len(codes), 7)]
    assert np.array_equal(np.concatenate(parts), whole) and len(starts) == 5


VECTORS = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, float("nan")], 1),
           (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [], 1)]


def test_near_texts_recall_of_small_groups(spark, monkeypatch):
    """A group of many near copies does not hide pairs that a round missed; the last round does not end quietly."""
    def words(name, n):
        return [f"{name}{i}" for i in range(n)]

    hot = [(i, " ".join([*words("h", 200), f"x{i}"])) for i in range(120)]
    pairs = [(1000 + 2 * p + i, " ".join([*words(f"p{p}w", 200), f"y{i}"])) for p in range(3) for i in range(2)]
    texts = spark.createDataFrame(hot + pairs, "doc_id long, text string")
    small = spark.createDataFrame([(bytearray(ngram_join.class_of(t.encode())[0]),) for _, t in pairs], "a binary")
    step, asked = ngram_join.candidate_links, []

    def missing(classes, turns, threshold):
        asked.extend(turns)
        found = step(classes, turns, threshold)
        return found.filter("turn > 0").union(found.filter("turn = 0").join(small, "a", "left_anti").select(found.columns))

    monkeypatch.setattr(ngram_join, "candidate_links", missing)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.join_near_texts(texts).collect()}
    assert asked == [0, 1, 2] and got[0] == 119 and {got[i] for i, _ in pairs} == {1}
    monkeypatch.setattr(ngram_join, "MOST_ROUNDS", 2)
    with pytest.raises(RuntimeError, match="recall"):
        ngram_join.join_near_texts(texts)


def test_embeddings_edge(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_embeddings(df).collect()}
    assert got[1] == got[2] == got[10] == got[None] == (3, 1)
    assert all(got[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11))
    assert embedding_dedup.link_embeddings(df.filter("false")).count() == 0


@pytest.mark.parametrize(("hot", "pairs"), [(0, [3002]), (700, [3000, 3001, 3002])])
def test_embeddings_audit_sees_small_groups(spark, monkeypatch, hot, pairs):
    """A first round that misses every pair is not the last one, with and without a large group."""
    rng = np.random.default_rng(3)
    rows, centre = [], rng.standard_normal(64)
    rows += [(i, centre + 0.02 * rng.standard_normal(64)) for i in range(hot)]
    rows += [(i, rng.standard_normal(64)) for i in range(hot, 2000)]
    for i in pairs:
        x = rng.standard_normal(64)
        rows += [(i, x), (i + 1000, x + 0.02 * rng.standard_normal(64))]
    space = spark.createDataFrame([(i, x.tolist(), 1) for i, x in rows], "vec_id long, embedding array<double>, label int")

    def without_pairs(step):
        def run(lists_or_nodes, *args):
            found = step(lists_or_nodes, *args)
            if run.calls:
                return found
            run.calls += 1
            few = (lists_or_nodes if "first" in lists_or_nodes.columns else args[0]).filter(F.col("first") >= min(pairs))
            return found.join(few.select(F.col("node").alias("u")), "u", "left_anti")

        run.calls = 0
        return run

    monkeypatch.setattr(embedding_dedup, "_seeded", without_pairs(embedding_dedup._seeded))
    monkeypatch.setattr(embedding_dedup, "_descend", without_pairs(embedding_dedup._descend))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_embeddings(space).collect()}
    assert [got[i + 1000] for i in pairs] == [(1, i) for i in pairs]
    assert got[0] == (hot - 1 if hot else 0, 0)


def test_embeddings_large_group(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    near = centre + 0.01 * rng.standard_normal((1500, 16))
    rows = [(i, x.tolist(), 0) for i, x in enumerate(np.vstack([near, rng.standard_normal((500, 16))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.link_embeddings(df)
    assert got.filter("n_links = 1499 and component_id = 0").count() == 1500 and got.filter("n_links = 0").count() == 500


def test_near_texts_edge(spark, edge, nothing):
    got = Counter(tuple(r) for r in ngram_join.join_near_texts(edge).select("doc_id", "class_id", "n_links", "component_id", "kept").collect())
    assert got[(4, 4, 1, 4, True)] == 2 and got[(None, 7, 2, 7, False)] == 2 and got[(7, 7, 2, 7, True)] == 1
    assert all(got[(i, i, 0, i, True)] == 1 for i in (1, 2, 3, 5, 6))
    kept = ngram_join.keep_one_of_each(edge)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7] and kept.columns == edge.columns
    assert ngram_join.join_near_texts(nothing).count() == 0 and ngram_join.keep_one_of_each(nothing).count() == 0


def test_near_texts_large_group(spark):
    """One group of near copies, larger than a bucket and a block, and texts with a common passage."""
    rng = np.random.default_rng(4)
    base, passage = [f"w{i}" for i in range(200)], [f"p{i}" for i in range(40)]
    rows = []
    for i in range(900):
        words = list(base)
        words[int(rng.integers(0, 200))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(passage + [f"y{i}_{j}" for j in range(100)])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = ngram_join.join_near_texts(df).collect()
    sets = {d: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for d, t in rows if d < 900}
    sample = [d for d in sets if d % 60 == 0]
    want = {d: sum(len(sets[d] & s) / len(sets[d] | s) >= 0.8 for e, s in sets.items() if e != d) for d in sample}
    links = {r["doc_id"]: r["n_links"] for r in got}
    assert {d: links[d] for d in sample} == want
    assert all(links[d] == 0 for d in links if d >= 1000) and sum(r["kept"] for r in got) == 901


def test_word_hashes_and_components(spark):
    hasher = common.WordHasher()
    texts = ["Ab, c\u00e9 d", "  AB", "", "d c\u00e9 ab " * 50]
    seen = {}
    for t in texts:
        words = WORD.findall(lowered(t))
        hashes = hasher.hashes(t.encode()).tolist()
        assert len(words) == len(hashes) and all(seen.setdefault(w, h) == h for w, h in zip(words, hashes))
    assert len(set(seen.values())) == len(seen)
    edges = [(i, i + 1) for i in range(200)] + [(300, 400), (400, 300)]
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert Counter(r["component"] for r in found) == {0: 201, 300: 2} and len(found) == 203


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name.startswith("token"):
            assert out.count() == docs.count()
            break
        assert out.columns == columns
        folder = str(tmp_path / name.replace(" ", "-").replace("/", "-"))
        out.write.parquet(folder)
        before, docs = docs, spark.read.parquet(folder)
        if name.startswith("n-gram"):
            kept = ngram_join.join_near_texts(before).filter("kept").select("doc_id")
            assert sorted(kept.collect()) == sorted(docs.select("doc_id").collect())
        if name.startswith("benchmark"):
            clean = decontaminate.find_contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("not contaminated")
            assert sorted(clean.select("doc_id").collect()) == sorted(docs.select("doc_id").collect())
