"""The training-data operators against brute force, on a fixture with nulls, empty, long, tied and repeated texts."""

import hashlib
import random
import re
import struct
import sys
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidewatch.llm import bpe, catalog, op1_packing, op2_substring, op3_bpe, op4_bagminhash, op5_pages, op6_quality, op7_counts, op8_iblt, op9_simple8b, op10_licences, stages

P = pytest.importorskip("public_tokenizers")
SPACE = "[^\x20\x09-\x0d]+"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)] + ["été", "naïve,", "日本", "it's", "100%", "<|endoftext|>", "a\x85b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(70), text(120)
    rows = [(k, text(rng.randint(0, 90)) + "\n" + text(rng.randint(0, 40))) for k in range(25)]
    rows += [(30 + k, f"{text(30)} {passage} {text(rng.randint(0, 30))}") for k in range(6)]
    rows += [(40 + k, base) for k in range(3)] + [(50 + k, base.replace(base.split()[k + 3], "edited", 1)) for k in range(5)]
    rows += [(60, None), (61, ""), (62, "   \n\t "), (63, "one"), (64, "line\n" * 40), (65, "x" * 5000), (66, text(9000)), (40, base), (None, "no id here"), (67, "The " * 60), (68, "Released under the MIT License.\n" + text(20))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", len(t or ""), "extra") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, edge string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = op1_packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    ids = Counter()
    for _, t in corpus():
        ids[np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += 1
    total = sum(len(x) // 4 * n for x, n in ids.items())
    assert sum(r.length for r in rows) == total
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024 and (end == 1024 or end & (end - 1) == 0)
    known = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in corpus()}
    for r in rows:
        own = known[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert op1_packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_columns_fill_sequences():
    histogram = dict(Counter(np.random.default_rng(0).integers(1, 64, 3000).tolist()))
    for pattern, _ in op1_packing.columns(histogram, 64):
        assert sum(r * k for r, k in pattern.items()) == 64
    plan = op1_packing.make_plan(histogram, 64)
    assert sum(plan.covered[r] * r for r in histogram) > 0.9 * sum(r * n for r, n in histogram.items())


def test_substrings(docs, empty):
    rows = [(i if i is not None else 1 << 62, re.findall(SPACE, t or "")) for i, t in corpus()]
    least: dict[tuple, int] = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            least[key] = min(least.get(key, i), i)
    want = Counter()
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[(None if i == 1 << 62 else i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in op2_substring.deduplicate(docs).collect()) == want
    assert op2_substring.deduplicate(empty).count() == 0


def test_round_trip_and_counts(docs, empty):
    import sentencepiece
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    encode = lambda t: library.encode(t or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter((i, len(encode(t)), sha(",".join(map(str, encode(t)))), sha(library.decode(encode(t), skip_special_tokens=False))) for i, t in corpus())
    assert Counter(tuple(r) for r in op3_bpe.round_trip(docs, P.path("byte_bpe_50k.json")).collect()) == want
    want = Counter((i, len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 4096) for i, t in corpus())
    assert Counter(tuple(r) for r in op7_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()) == want
    assert Counter(tuple(r) for r in op7_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), chunk=40, group=3).collect()) == want
    assert op3_bpe.round_trip(empty, P.path("byte_bpe_50k.json")).count() == 0 and op7_counts.count_tokens(empty, P.path("piece_bpe_32k.model"), chunk=40).count() == 0


@pytest.mark.parametrize("chunk", [1, 17, 33, 300])
def test_chunk_maps_compose(chunk):
    import sentencepiece

    t, library = op7_counts.transducer(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    parts = ["a", "ing", "tion", " ", "  ", "      ", "\n", "\u2581", "日本語", "é", "\U0001f3f4", "</s>", "xxxxxxxx"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(200)] + ["x" * 500, "日本" * 200, " " * 400, " " * 90 + "a" * 90, "a\n" * 90, "\n", " "]
    for text in texts:
        assert t.total(text, chunk) == len(library.encode(text))
    maps = [t.state_map(*c) for c in t.chunks(op7_counts.marked("pneumonoultramicroscopic" * 40 + " and " * 30), 20)]
    left, right = maps[0], maps[-1]
    for m in maps[1:]:
        left = op7_counts.compose(left, m)
    for m in maps[-2::-1]:
        right = op7_counts.compose(m, right)
    assert len(maps) > 10 and left == right and any(len(m) > 1 for m in maps)


def test_automaton_accepts_encodings_alone():
    """Over all short strings: of all ways to spell a string, exactly the one that merging in rank order gives is a path."""
    letters, merges = "abc", [("a", "b"), ("a", "a"), ("ab", "c"), ("b", "c"), ("aa", "ab"), ("c", "ab"), ("b", "b"), ("aa", "aa")]
    names = [*letters, *(a + b for a, b in merges)]
    ids = {s: k for k, s in enumerate(names)}
    a = bpe.MergeAutomaton({k: tuple(map(ord, s)) for s, k in ids.items()}, [(ids[x], ids[y], ids[x + y]) for x, y in merges])
    words = [""]
    for _ in range(7):
        words = [w + c for w in words for c in letters]
        for w in words:
            parts = list(w)
            for x, y in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (x, y):
                        parts[k : k + 2] = [x + y]
                    k += 1
            ways = [[]]
            accepted = []
            while ways:
                way = ways.pop()
                at = sum(map(len, way))
                if at == len(w):
                    accepted.append(way)
                state = a.start if not way else a._targets[ids[way[-1]]]
                ways += [[*way, s] for s in names if w.startswith(s, at) and a.has_arc(state, ids[s])]
            assert accepted == [parts]
    symbols = np.array([[ord(c) for c in w] for w in words])
    assert a.encode(list(symbols)) == [[ids[x] for x in w] for w in (_merged(list(w), merges) for w in words)]


def _merged(parts, merges):
    for x, y in merges:
        k = 0
        while k < len(parts) - 1:
            if (parts[k], parts[k + 1]) == (x, y):
                parts[k : k + 2] = [x + y]
            k += 1
    return parts


def test_near_duplicates(docs, empty):
    bags = {}
    for i, t in corpus():
        w = re.findall(SPACE, t or "")
        bags[(i, t or "")] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    keys = list(bags)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            both = sum((bags[keys[a]] & bags[keys[b]]).values())
            if both and both >= 0.8 * max(sum(bags[keys[a]].values()), sum(bags[keys[b]].values())):
                root[find(keys[a])] = find(keys[b])
    least: dict = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), 1 << 62), k[0] if k[0] is not None else 1 << 62)
    got = op4_bagminhash.classes(docs).collect()
    assert len(got) == len(corpus())
    want = Counter((i if i is not None else op2_substring.LAST, least[find((i, t or ""))] if least[find((i, t or ""))] < 1 << 62 else op2_substring.LAST) for i, t in corpus())
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert op4_bagminhash.classes(empty).count() == 0


def test_signatures_are_unbiased():
    a, b = {k: 1 + k % 3 for k in range(300)}, {k: 1 + (k + k // 200) % 3 for k in range(60, 360)}
    runs = op4_bagminhash.mix(np.array([*a, *b], np.uint64))
    sig = op4_bagminhash.signatures(np.repeat([0, 1], [len(a), len(b)]), runs, np.array([*a.values(), *b.values()]), 2, 4096)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(360)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(360))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_pages(spark):
    body = '<html><head><title>t</title></head><body><nav>Menu</nav><div class="cookie-notice">ok?</div><article><h1>A &amp; B</h1><p>one<br>two &nbsp; three<p>four</p></article><aside>x</aside></body>'
    plain = "<p>Shared menu</p><p>{}</p><p>Shared foot</p>"
    rows = [(1, "http://h.x/a", body), (2, "http://p.x/a", plain.format("first")), (3, "http://p.x/b?q", plain.format("second")), (4, None, None), (5, "http://z.x/", ""), (6, "bad url", "<p>alone")]
    got = {r.page_id: r.text for r in op5_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B\none two three\nfour", 2: "first", 3: "second", 4: "", 5: "", 6: "alone"}
    assert op5_pages.shared(list("axbyc"), list("abzc")) == {0, 2, 4}


def test_lines_outside_an_article_stay_unless_shared(spark):
    page = "<div><p>Menu</p><p>{}</p></div><article><p>Menu</p><p>teaser</p></article><footer>foot</footer>"
    rows = [(1, "http://h.x/a", page.format("first")), (2, "http://h.x/b", page.format("second"))]
    got = {r.page_id: r.text for r in op5_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "first\nMenu\nteaser", 2: "second\nMenu\nteaser"}


def test_names_count_as_a_whole():
    page = (
        '<article id="main"><section id="search-algorithms"><h2 id="related-work">Related work</h2><h2 id="comments">On comments</h2><div class="legal-history">Laws</div>'
        '<p>at <span class="share-price">12</span> euro</p><p class="notice">Notice</p></section><section id="search">Trees</section>'
        '<div class="ad">Buy</div><p class="ads">Buy</p><div class="share-bar">Share</div><section id="comments">First!</section><div role="navigation">Next</div></article>'
    )
    assert op5_pages.main_text(op5_pages.lines(page), None) == "Related work\nOn comments\nLaws\nat 12 euro\nNotice\nTrees"
    assert op5_pages.lines("<article class=\"comment\"><p>c</p></article><p class=\"comment\">p</p>") == [(op5_pages.GO, "c"), (op5_pages.OPEN, "p")]
    outside = '<div id="search-algorithms">a</div><h2 id="related-work">b</h2><div class="legal-history">c</div><div class="legal">d</div><div data-id="ad">e</div>'
    gone = '<div class="site-footer">v</div><div id="sidebar">w</div><div class="cookieNotice">x</div><div class="search-box">y</div><p hidden>z</p>'
    assert op5_pages.main_text(op5_pages.lines(outside + gone), None) == "a\nb\nc\nd\ne"


def test_copies_keep_their_text(spark):
    page = "<p>Menu</p><p>A body of some length, longer than all the rest, that is the main text of this page and of its copy.</p><p>Printed {}</p>"
    rows = [(1, "http://h.x/a", page.format(1)), (2, "http://h.x/a?print", page.format(1)), (3, "http://i.x/a", page.format(1)), (4, "http://i.x/a?p", page.format(2))]
    got = {r.page_id: r.text.split("\n")[:2] for r in op5_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys((1, 2, 3, 4), ["Menu", "A body of some length, longer than all the rest, that is the main text of this page and of its copy."])


def test_pairing_is_the_same_under_any_ranges(spark):
    page = "<p>Menu of {}</p><p>{}</p><p>Foot of {}</p>"
    rows = [(k, f"http://h{k % 3}.x/{k // 2 % 40:03}", page.format(k % 3, f"text {k // 9}" if k % 5 else "text", k % 3)) for k in range(-30, 200)]
    rows += [(200 + k, "http://h1.x/012", page.format(1, "a copy of some length, with its menu and its foot. " * 5, 1)) for k in range(6)] + [(None, "http://h1.x/012", "<p>no id"), (7, None, "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = [Counter(map(tuple, op5_pages.extract(pages, n).collect())) for n in (1, 2, 7, 60)]
    assert len(rows) == sum(got[0].values()) and got[0] == got[1] == got[2] == got[3]
    texts = {r[0]: r[2] for r in got[0] if r[1] and "h0" in r[1]}
    assert not any("Menu" in t or "Foot" in t for t in texts.values())


def test_quality(docs, empty, spark):
    def stats(t):
        w = re.findall(SPACE, t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if re.search(SPACE, line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if many[g] > 1:
                covered |= set(range(k, k + 8))
        return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)

    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = op6_quality.judge(docs, []).select("doc_id", *cols).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *stats(t)) for i, t in corpus())
    assert op6_quality.judge(empty, []).count() == 0
    rng = np.random.default_rng(4)
    x = {"symbol_share": rng.random(3000), "upper_share": rng.random(3000)}
    bad = (x["symbol_share"] > 0.7) | (x["upper_share"] < 0.1)
    rules = op6_quality.learn(x, bad)
    hit = np.any([op6_quality.covers(r, x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.97


def test_quality_stage_judges_rows(spark):
    good = " ".join(f"word{k}" for k in range(60)) + "."
    rows = [(None, good, "en"), (None, "short", "en"), (-7, good, "de"), (-7, "too short", "fr"), (-8, None, "en"), (-7, good, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    kept = op6_quality.quality_stage(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[1] == good)


def test_fingerprints(docs, empty, spark):
    ids = [(i, t or "") for i, t in corpus() if i is not None]
    ids = sorted({i: t for i, t in ids}.items(), reverse=True)
    rows = op8_iblt.fingerprints(spark.createDataFrame(ids, "doc_id long, text string")).collect()
    units = lambda t: set(re.findall("(?:[^ \n]+ *){1,16}", t))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = {r.doc_id: r for r in rows}
    for k, (i, t) in enumerate(ids):
        after = ids[(k + 1) % len(ids)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(units(t), units(edited))) and r.near_next == pytest.approx(like(units(t), units(after)))
    assert op8_iblt.fingerprints(docs).count() == len(corpus()) and op8_iblt.fingerprints(empty).count() == 0


def test_simple8b(docs, empty, spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(0)
    for high in (1, 2, 300, 50_000, 1 << 29, 1 << 40):
        for n in (0, 1, 240, 4097, 9000):
            ids = rng.integers(0, high, n)
            assert (op9_simple8b.decode_ids(*(lambda w, o, a, v: (w, n, o, a, v))(*op9_simple8b.encode_ids(ids))) == ids).all()
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    op9_simple8b.write_files(docs, P.path("word_bpe_49k.json"), f"{tmp_path}/ids", 2, 3)
    got = sorted(op9_simple8b.read_files(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    texts = sorted(((i is not None, i or 0, (t or "").encode()), t or "") for i, t in corpus())
    start = 0
    for r, (_, t) in zip(got, texts, strict=True):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_licences(docs, empty):
    got = {r.doc_id: r for r in op10_licences.scan(docs).collect()}
    assert got[68].license == "MIT" and got[68].dice == 1.0 and got[68].line_no == 1 and got[0].license is None
    s = op10_licences.Scanner(op10_licences.TEMPLATES, 0.8)
    for name, t in op10_licences.TEMPLATES.items():
        assert s.best(t.upper()) == (1.0, name)
        own = op10_licences.bigrams(t + " indeed")
        dice = {n: 2 * len(own & g) / (len(own) + len(g)) for n, g in s.templates}
        best = max(dice.values())
        assert (s.best(t + " indeed") or (0,))[0] == (best if best >= 0.8 else 0)
    assert op10_licences.scan(empty).count() == 0


def test_licences_inside_longer_units():
    s = op10_licences.Scanner(op10_licences.TEMPLATES, 0.8)
    filler = " ".join(f"w{k}" for k in range(300))
    assert s.scan("Released under the MIT License. See LICENSE for details.") == (1, 1, "MIT", 1.0, 1)
    assert s.scan("a\nCopyright 2021 Acme Corp. All rights reserved. Released under the MIT License.") == (2, 1, "MIT", 1.0, 2)
    assert s.scan(f"{filler} Licensed under CC BY-SA 4.0.") == (1, 1, "CC-BY-SA-4.0", 1.0, 1)
    grant = op10_licences.TEMPLATES["MIT-grant"].split()
    block = "\n".join(["/*", " * " + filler, " *", *(" * " + " ".join(grant[k : k + 6]) for k in range(0, len(grant), 6)), " *", " * " + filler, " */"])
    assert s.scan(block) == (len(block.split("\n")), 0, "MIT-grant", 1.0, 4)
    rng = random.Random(5)
    for _ in range(60):  # all windows by brute force
        name = rng.choice(sorted(op10_licences.TEMPLATES))
        words = [w for w in op10_licences.WORDS(op10_licences.TEMPLATES[name].lower()) for _ in range(rng.choice([1, 1, 1, 1, 1, 1, 2, 0]))]
        words = [f"x{rng.randrange(5)}" for _ in range(8)] + words + words[: rng.randrange(5)] + [f"x{rng.randrange(5)}" for _ in range(8)]
        best = 0.0
        for a in range(len(words)):
            own = set()
            for b in range(a + 1, len(words)):
                own.add((words[b - 1], words[b]))
                best = max([best, *(2.0 * len(own & g) / (len(own) + len(g)) for _, g in s.templates)])
        assert (s.scan(" ".join(words))[3] or 0) == (best if best >= 0.8 else 0)


SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    """All stages over the smallest tables against brute force."""
    import corpus_pipeline

    base = SF
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{base}/documents.parquet")
    kept = op6_quality.quality_stage(spark, docs, base)
    rules = op6_quality.fit(docs, spark.read.parquet(f"{base}/labels.parquet"))
    verdict = {r.doc_id: r for r in op6_quality.judge(docs, rules).collect()}
    good = {i for i, r in verdict.items() if not r.base_failed and not any(all((r[c.feature] >= c.threshold) == c.above or r[c.feature] == c.threshold for c in rule) for rule in rules)}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    assert {r.doc_id for r in kept.collect()} == good == {i for i, r in verdict.items() if r.kept} and 0 < len(good) < 200
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in texts.items() for w in [re.findall(SPACE, t)]}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and sum((bags[a] & bags[b]).values()) >= 0.8 * max(sum(bags[a].values()), sum(bags[b].values())):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    unique = op4_bagminhash.near_duplicate_stage(spark, kept, base)
    first = {i for i in bags if find(i) == i}
    assert {r.doc_id for r in unique.collect()} == first
    cleaned = op2_substring.substring_stage(spark, unique, base)
    least: dict[tuple, int] = {}
    words = {i: re.findall(SPACE, texts[i]) for i in first}
    for i, w in words.items():
        for k in range(len(w) - 49):
            least[tuple(w[k : k + 50])] = min(least.get(tuple(w[k : k + 50]), i), i)
    left = {}
    for i, w in words.items():
        gone = {x for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    got = {r.doc_id: r for r in cleaned.collect()}
    assert {i: re.findall(SPACE, r.text) for i, r in got.items()} == {i: w for i, w in left.items() if w}
    assert all(r.n_chars == len(r.text) for r in got.values() if len(left[r.doc_id]) < len(words[r.doc_id]))
    out = corpus_pipeline.run(spark, base).collect()
    assert Counter(r.doc_id for r in out).keys() == got.keys() and kept.columns == unique.columns == cleaned.columns == docs.columns
    assert all(sum(r.length for r in out if r.doc_id == i) == next(r.doc_tokens for r in out if r.doc_id == i) for i in list(got)[:10])


def test_stages_keep_rows_and_columns(spark):
    """Null and repeated ids, repeated rows, columns of clashing names, and an empty table."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    a, b, c, passage = text(90), text(90), text(90), text(60)
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (None, c, "n"), (None, c, "n"), (3, c, "late"), (1, b, "again"), (5, f"{text(40)} {passage} {text(40)}", "p"), (6, f"{text(40)} {passage} {text(40)}", "q"), (7, passage, "gone")]
    names = ["_doc", "_text", "_row", "_id", "row", "key", "new", "edge", "kmer", "n_words"]
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    for stage in (op6_quality.quality_stage, op4_bagminhash.near_duplicate_stage, op2_substring.substring_stage):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and all(tuple(r)[3:] == tuple(names) for r in out.collect())
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert op6_quality.quality_stage(spark, docs, SF).count() == len(rows)
    kept = sorted(((r.doc_id or 0), r.text, r.lang) for r in op4_bagminhash.near_duplicate_stage(spark, docs, SF).collect())
    assert kept == sorted([(1, a, "x"), (1, b, "again"), (3, c, "late"), *(r for r in rows if r[0] in (5, 6, 7))])
    out = op2_substring.substring_stage(spark, docs, SF)
    left = {(r.doc_id, r.lang): r.text for r in out.collect()}
    assert left[(5, "p")] == rows[7][1] and len(left[(6, "q")].split()) == 80 and (7, "gone") not in left
    assert left[(1, "x")] == a and (2, "z") not in left and (None, "n") not in left and left[(1, "y")] == left[(1, "again")] == b
    assert op1_packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0 and stages.STAGES[0][1] is op6_quality.quality_stage


def test_unequal_words_are_told(spark):
    """What hashes claim to be equal is compared by its words; on a difference all is done again with other hashes."""
    docs = op2_substring.source(spark.createDataFrame([(1, "a b c d"), (2, "a b x d"), (3, "z a b c")], "doc_id long, text string"))
    claim = lambda k, d, f, but="cast(null as int) but", upto="cast(null as int) upto": docs.where(f"doc_id = {d}").selectExpr("doc_id", "row_key", f"{k}L as k1", "0L as k2", f"{f} as first", "3 as n", but, upto)
    claims = claim(7, 1, 0).union(claim(7, 3, 1)).union(claim(8, 1, 0)).union(claim(8, 2, 0))
    claims = claims.union(claim(9, 1, 0, "2 but", "3 upto")).union(claim(9, 2, 0, "2 but", "3 upto")).union(claim(9, 3, 1, "3 but", "4 upto"))
    assert [tuple(r) for r in op2_substring.unequal(docs, claims).collect()] == [(8, 0)]


def test_unequal_words_at_any_place(spark):
    rng = random.Random(4)
    texts = ["", *(rng.choice(["", "\n "]) + "".join(rng.choice(["é", "b", "日本c"]) + rng.choice([" ", " \t"]) for _ in range(rng.randint(0, 12))) for _ in range(12)), "b"]
    words, rows, want = [re.findall(SPACE, t) for t in texts], [], {}
    for k in range(600):
        d, key, first, n = rng.randrange(len(texts)), k // 2, rng.randint(0, 6), rng.randint(0, 4)
        but, upto = (rng.randint(0, 8), rng.randint(0, 12)) if key % 3 == 0 else (None, None)
        rows.append((d, key, -key, first, n, but, upto))
        b, w = first + n, words[d]
        want.setdefault(key, set()).add(tuple(w[first:b] if but is None else [*w[first : max(first, but)], "", *w[min(b, upto) : b]]))
    docs = op2_substring.source(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).coalesce(2)
    claims = spark.createDataFrame(rows, "doc_id long, k1 long, k2 long, first int, n int, but int, upto int").join(docs.drop("text"), "doc_id")
    got = [tuple(r) for r in op2_substring.unequal(docs, claims).collect()]
    differ = sorted((k, -k) for k, v in want.items() if len(v) > 1)
    assert sorted(got) == differ and 50 < len(differ) < 290


def test_substrings_do_not_depend_on_hashes(docs):
    one, two = (op2_substring.repeats(docs, salt=k)[1].select("doc_id", "row_key").collect() for k in (0, 1))
    assert sorted(one) == sorted(two) and len(one) > 5


def test_paths_compact(spark):
    """Copies of a long text are one path; a passage in other texts is another."""
    long = " ".join(f"w{k}" for k in range(2000))
    docs = spark.createDataFrame([(1, long), (2, long), (3, " ".join(long.split()[500:700])), (4, "u " * 30 + " ".join(long.split()[900:1000]))], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in op2_substring.deduplicate(docs).collect()}
    assert got == {1: 0, 2: 2000, 3: 200, 4: 100}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    theirs = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in theirs.description]
    show = lambda rows: sorted(map(repr, rows))
    out = catalog.QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(names) and show(map(tuple, out.select(*names).collect())) == show(theirs.fetchall())


def test_near_duplicates_of_some_against_all(spark):
    """Every document whose id is divisible by 50 against all others, exactly."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bags = {r.doc_id: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for r in rows for w in [re.findall(SPACE, r.text or "")]}
    got = {r.doc_id: r.class_id for r in catalog.QUERIES["op4_near_duplicates"](spark, SF).collect()}
    assert got.keys() == bags.keys()
    for a in (i for i in bags if i % 50 == 0):
        for b in bags:
            if (both := sum((bags[a] & bags[b]).values())) and both >= 0.8 * max(sum(bags[a].values()), sum(bags[b].values())):
                assert got[a] == got[b]


def test_near_duplicates_in_hot_bands(spark, monkeypatch):
    """Small limits: further star rounds, narrower keys and blocks of large classes give the links of all pairs."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(words)))
    bags = [Counter(tuple(t.split()[k : k + 5]) for k in range(146)) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * 146:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert 3 < len(set(root)) < 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans, narrow = [], op4_bagminhash.narrowed
    monkeypatch.setattr(op4_bagminhash, "BLOCK", 4)
    monkeypatch.setattr(op4_bagminhash, "HOT", 8)
    monkeypatch.setattr(op4_bagminhash, "narrowed", lambda left, nodes: spans.append((left.count(), (out := narrow(left, nodes)).count())) or out)
    got = {r.doc_id: r.class_id for r in op4_bagminhash.classes(docs, rounds=2).collect()}
    assert got == dict(enumerate(root))
    assert spans and spans[0][1] != spans[0][0]


def test_pages_against_brute_force(spark):
    """The whole table: plain longest common subsequences, neighbours by sorting; equal under any ranges."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id", "url", "html", "'x' as text", "'y' as host", "'z' as key")
    rows = sorted((re.sub(r"^[a-zA-Z][\w+.-]*://([^/?#]*)([^?#]*).*$", lambda m: m[1].lower() + op5_pages.SEPARATOR + m[2], r.url or "", flags=re.S) if re.match(r"[a-zA-Z][\w+.-]*://", r.url or "") else op5_pages.SEPARATOR, r.page_id, r.url, op5_pages.lines(r.html or "")) for r in pages.collect())

    def plain(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
        return n[0][0]

    want, decided = {}, 0
    for k, (key, page_id, _, page) in enumerate(rows):
        host = key.split(op5_pages.SEPARATOR)[0]
        around = [*range(k - 1, max(-1, k - 1 - op5_pages.NEAR), -1), *range(k + 1, min(len(rows), k + 1 + op5_pages.NEAR))]
        near = next((rows[x][3] for x in around if host and rows[x][0].split(op5_pages.SEPARATOR)[0] == host and not op5_pages.copies(page, rows[x][3])), None)
        mine = [t for _, t in page]
        same = op5_pages.shared(mine, [t for _, t in near]) if near else set()
        assert len(same) == (plain(mine, [t for _, t in near]) if near else 0)
        decided += len(same)
        want[page_id] = "\n".join(t for x, (role, t) in enumerate(page) if role == op5_pages.STAY or role == op5_pages.OPEN and x not in same)
    for n in (1, 4, 32):
        got = op5_pages.extract(pages, n).collect()
        assert {r.page_id: r.text for r in got} == want and len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert op5_pages.extract(pages.limit(0)).count() == 0
    twice = op5_pages.extract(pages.union(pages), 3).collect()
    assert len(twice) == 2 * len(rows) and all(a.text == b.text for a in twice for b in twice[:20] if a.page_id == b.page_id)


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<a "' * 250_000 + ">", "<a ='\"" * 150_000, "<div>" * 60_000 + "</p>" * 60_000 + "</b>" * 60_000, "<" * 1_000_000, "<p>" + "word " * 200_000])
def test_pages_are_read_in_linear_time(page):
    t = time.time()
    op5_pages.lines(page)
    assert time.time() - t < 5


def test_tags_end_where_browsers_end_them():
    got = op5_pages.lines("<div title=\"x>y\">a</div><p title='a>b'>q<br/>r</p><a href=x>z</a> 1 < 2 <3<p>left<a href=")
    assert [t for _, t in got] == ["a", "q r", "z 1 < 2 <3", "left"]


def checked(digest: int) -> int:
    """The check hash of a digest: of its eight bytes, then of the number 7."""
    return xxhash.xxh64_intdigest(struct.pack("<i", 7), xxhash.xxh64_intdigest(struct.pack("<Q", digest), 42)) & 0xFFFFFFFF


def test_fingerprints_are_sketches(spark):
    """The cells of a fingerprint by hand, and exact differences where sketches of any size fail."""
    text = "\n".join(f"paragraph number {k}" for k in range(40))
    (r,) = op8_iblt.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    digests = {xxhash.xxh64_intdigest(u.encode(), 42) for u in re.findall("(?:[^ \n]+ *){1,16}", text)}
    cells = f"{len(digests):X}".zfill(8)
    for bits, shift in ((2, 0), (5, 6)):
        for j in range(3 << bits):
            own = [d for d in digests if (d >> (shift + (j >> bits) * bits)) & ((1 << bits) - 1) == j & ((1 << bits) - 1)]
            x = c = 0
            for d in own:
                x ^= d
                c ^= checked(d)
            cells += f"{len(own):X}".zfill(4) + f"{x:X}".zfill(16) + f"{c:X}".zfill(8)
    assert r.fingerprint == cells
    (n,) = spark.sql("select " + op8_iblt.group("array(1L, 2L, 3L)", "array(3L, 7L)") + " as n").first()
    assert n == 3
    same = ", ".join(f"{k << 12}L" for k in range(1, 60))  # all in the same cells of the unsalted sketches
    assert spark.sql(f"select {op8_iblt.group(f'array({same})', 'array(5L)')} as n").first()[0] == 60


def near_by_strings(a: str, b: str) -> float | None:
    """Likeness from two fingerprints and nothing else; none if neither sketch can be peeled."""
    m, other = int(a[:8], 16), int(b[:8], 16)
    read = lambda t: [(int(t[k : k + 4], 16), int(t[k + 4 : k + 20], 16), int(t[k + 20 : k + 28], 16)) for k in range(8, len(t), 28)]
    x, y = read(a), read(b)
    for bits, shift, lo, hi in ((2, 0, 0, 12), (5, 6, 12, 108)):
        cells = [[(p[0] - q[0] + 98304) % 65536 - 32768, p[1] ^ q[1], p[2] ^ q[2]] for p, q in zip(x[lo:hi], y[lo:hi], strict=True)]
        found = 0
        while one := next((c for c in cells if abs(c[0]) == 1 and c[2] == checked(c[1])), None):
            n, k, c = one
            found += 1
            for t in range(3):
                cell = cells[(t << bits) + ((k >> (shift + t * bits)) & ((1 << bits) - 1))]
                cell[0], cell[1], cell[2] = cell[0] - n, cell[1] ^ k, cell[2] ^ c
            if found > len(cells):
                break
        if not any(c[0] or c[1] for c in cells):
            return 1.0 if m + other == 0 else (m + other - found) / (m + other + found)
    return None


def test_likeness_is_a_function_of_two_fingerprints(docs, spark):
    """Null and repeated ids and repeated rows too: each row's likeness to its edited text follows from its two strings, and to the next document from that one's string."""
    rows = op8_iblt.fingerprints(docs.unionByName(docs.where("doc_id in (3, 40)"))).collect()
    assert len({len(r.fingerprint) for r in rows} | {len(r.edited_fingerprint) for r in rows}) == 1
    alone = [r for r in rows if r.edited_by_fingerprint]
    assert len(alone) > 0.9 * len(rows) and sum(r.next_by_fingerprint for r in rows) > 0.8 * len(rows)
    for r in alone:
        assert near_by_strings(r.fingerprint, r.edited_fingerprint) == pytest.approx(r.near_edited)
    prints = {r.fingerprint for r in rows}
    for r in rows:
        if r.next_by_fingerprint:
            assert any(near_by_strings(r.fingerprint, f) == pytest.approx(r.near_next) for f in prints)
    twice = [r for r in rows if r.doc_id in (3, 40)]
    assert len(twice) == 2 + 4 and len({tuple(r) for r in twice if r.doc_id == 3}) == 1  # repeated rows have equal results
    assert len({r.fingerprint for r in twice if r.doc_id == 40}) == 1 and sum(r.doc_id is None for r in rows) == 1


def test_word_splits_agree():
    w = op2_substring.Words(pa.array(["  a b\x0bc ", "", "d\x85e f"]))
    assert w.flat.to_pylist() == ["a", "b", "c", "d\x85e", "f"] and w.sizes.tolist() == [3, 0, 2]


def test_word_hashes():
    words = ["", *(c * n for c in ("a", "b", "\0", "é") for n in (1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65, 200)), "a\0", "\0a", "日本", *map(str, range(20000))]
    for kind in (pa.string(), pa.large_string()):
        one, two = (op2_substring.word_hashes(pa.array(words, kind), salt) for salt in (0, 1))
        assert len({*one.tolist(), *two.tolist()}) == 2 * len(words)
        assert (op2_substring.word_hashes(pa.array(words, kind).slice(30, 500)) == one[30:530]).all()
    assert len(op2_substring.word_hashes(pa.array([], pa.string()))) == 0


def test_words_take_no_python_each(monkeypatch):
    """Hashes and digests of a batch take a few calls a text, not some for each word."""
    texts = [" ".join(f"{k}x{j}" for j in range(300)) for k in range(200)]
    ids = pa.array(range(len(texts)), pa.int64())
    held = []
    monkeypatch.setattr(op2_substring, "arrow_map", lambda docs, run, schema: held.append(run))
    op2_substring.occurrences(None, 50, 12, 0)
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        out = list(held[0](iter([pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "row_key", "text"])])))
    finally:
        sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < 6000
    assert out[0].column("sha").to_pylist() == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


@pytest.mark.parametrize(("module", "call"), [(op4_bagminhash, lambda m: m.signed(None)), (op2_substring, lambda m: m.occurrences(None, 50, 12, 0))])
def test_arrays_of_a_batch_are_small(monkeypatch, module, call):
    """A worker works on parts of a batch, as two workers and Spark share an executor's memory; parts give the rows of the whole batch."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 3000, 450)) for _ in range(1500)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "row_key", "text"])
    held = []
    monkeypatch.setattr(module, "arrow_map", lambda docs, run, schema: held.append(run))
    call(module)
    tracemalloc.start()
    n = sum(out.num_rows for out in held[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert n == sum(out.num_rows for k in range(0, 1500, 100) for out in held[0](iter([batch.slice(k, 100)]))) >= 1500
