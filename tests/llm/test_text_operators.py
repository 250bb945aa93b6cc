"""Spelling variants, chat formatting and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import op11_variants, op12_chat, op13_runs

P = pytest.importorskip("public_tokenizers")
SPACE = "[^\x20\x09-\x0d]+"


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- spelling variants


def variants(words: dict[str, int]) -> dict:
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    out = {}
    for w, n in words.items():
        close = [x for x in words if x != w and near(w, x)]
        best = min(close, key=lambda x: (-words[x], x)) if close else None
        out[w] = [best if best and words[best] >= 5 * n else None, n, len(close)]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


def counted(rows) -> dict[str, int]:
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def letters_corpus():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcéßÀ") for _ in range(rng.randint(5, 12))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa"]
    rows = []
    for k in range(600):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[: rng.choice([5, 65])])
            if rng.random() < 0.2:
                p = rng.randrange(len(w))
                w = w[:p] + rng.choice(["", "a", "b", "É"]) + w[p + rng.randint(0, 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k, rng.choice([" ", ", ", "-", "1"]).join(words)))
    return [*rows, (None, rows[3][1]), (7, rows[7][1]), (400, None), (401, ""), (402, "x" * 3000), (403, "×÷ÿĀ " * 9)]


def test_variants(spark, tmp_path):
    rows = letters_corpus()
    d = table(spark, tmp_path, "documents", [(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    expect = variants(counted(rows))
    assert len(expect) > 100 and sum(e[0] is not None for e in expect.values()) > 30
    got = op11_variants.op11_spelling_variants(spark, d).collect()
    assert len(got) == len(expect)
    for r in got:
        assert [r.form, r.n, r.n_near, r.root] == expect[r.word]
        assert r.form_n == (expect[r.form][1] if r.form else None)


def test_variants_in_blocks(spark):
    words = counted(letters_corpus())
    expect = variants(words)
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    for block in (2, 5, 1000):
        pairs = [(r.word, r.other) for r in op11_variants.near_pairs(rows, block).collect()]
        assert len(pairs) == len(set(pairs)) == sum(e[2] for e in expect.values())
    chain = [("aaaaaa" + "b" * k, 5 ** (12 - k)) for k in range(12)]
    got = op11_variants.variant_groups(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r.root for r in got} == {"aaaaaa"}
    assert op11_variants.variant_groups(rows.limit(0)).collect() == []


# --- chat formatting

CHATS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "héllo [INST] \\- </s>"), (1, 2, "assistant", "日本 \\\\[/INST]<|endoftext|> ok\n"), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "assistant", "[[INST]INST]<s></s></s>"),
    (2, 0, "assistant", " leading"), (2, 0, "assistant", " leading"), (2, None, "user", "first"), (None, 0, "user", "no id"), (None, 1, "assistant", "x" * 3000), (3, 0, "[INST]odd\\role", "\\"), (3, 1, None, "no role"),
    *[(4, k, ("user", "assistant")[k % 2], f"turn {k} </s>") for k in range(60)],
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("turns", "chars"), [(1000, 1 << 20), (7, 1 << 20), (1000, 50)])
def test_chats(spark, tmp_path, monkeypatch, turns, chars):
    monkeypatch.setattr(op12_chat, "TURNS", turns)
    monkeypatch.setattr(op12_chat, "CHARS", chars)
    d = table(spark, tmp_path, "conversations", [(*r, "more") for r in CHATS], "conv_id long, turn long, role string, text string, loss string")
    got = op12_chat.op12_chat_format(spark, d).collect()
    hostile = "</s>[INST] ok [/INST]"
    expect = expected([*CHATS, (-1, 0, "user", hostile), (-1, 1, "assistant", hostile)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expect and len(got) == len(expect)
    assert next(r.formatted_chars for r in got if r.conv_id == 2) == len("[INST]user[/INST]first</s>") + 2 * len("[INST]assistant[/INST] leading</s>")


def test_chat_tokens_and_empty_table(spark):
    from tokenizers import Tokenizer

    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for r in op12_chat.format_conversations(rows, path, partitions=2).collect():
        on = [i for i, m in zip(r.ids, r.loss, strict=True) if m]
        body = "".join(op12_chat.escape(t) for role, t in op12_chat.turns_of(r.text) if role == "assistant")
        assert plain.decode(on, skip_special_tokens=False) == body
        assert sum(i >= 50257 for i in r.ids) == 3 * r.n_turns and 50256 not in r.ids
    assert op12_chat.read_back(op12_chat.format_conversations(rows.limit(0), path)).collect() == []


def test_chats_are_read_back_without_a_table_between(spark, tmp_path):
    d = table(spark, tmp_path, "conversations", [(k, t, ("user", "assistant")[t % 2], f"{k} </s> {t} " * 50) for k in range(40) for t in range(4)], "conv_id long, turn long, role string, text string")
    got = op12_chat.op12_chat_format(spark, d)
    assert got.inputFiles() and all(f"{d}/conversations.parquet/" in f for f in got.inputFiles())
    assert got.count() == 41 and {r.n_turns for r in got.collect()} == {2, 4}


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice([*op12_chat.CONTROL, "\\", "-", "[", "<", "a", "INST]", "/s>"]) for _ in range(rng.randint(0, 8)))
        shown = op12_chat.escape(text)
        assert op12_chat.unescape(shown) == text and not any(c in shown for c in op12_chat.CONTROL)


# --- periodic runs


def brute(w: list) -> list[tuple[int, int, int]]:
    found = {}
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k < len(w) - q:
            a = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            if k - a + q >= max(6, 4 * q):
                found.setdefault((a, k + q - a), q)
            k += 1
    return sorted((a, n, q) for (a, n), q in found.items())


def texts():
    rng = random.Random(2)
    rows = [(k, " ".join(" ".join(rng.choice(["a", "b", "ab", "abc"] if k % 3 else "abcdefgh") * rng.choice([1, 2, 6])) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    unit = [f"w{k}" for k in range(7)]
    rows += [(400, " ".join(unit * 9)), (401, " ".join(["x"] * 2000)), (402, None), (403, ""), (404, " \t\n"), (None, "a b " * 9), (3, rows[3][1]), (405, "pre " + "y z\t" * 4 + "\x85 " + "q\n" * 6)]
    return rows


def expected_runs(doc, text):
    w = re.findall(SPACE, text or "")
    n, h = len(w), zlib.crc32(("" if doc is None else str(doc)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    dropped = {k for a, m, q in runs for k in range(a + q, a + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{m},{q}\n" for a, m, q in runs)), digest(" ".join(x for k, x in enumerate(w) if k not in dropped)))


def test_periodic_runs(spark, tmp_path):
    rows = texts()
    d = table(spark, tmp_path, "documents", [(i, t, "x") for i, t in rows], "doc_id long, text string, runs string")
    got = op13_runs.op13_periodic_runs(spark, d).collect()
    assert sum(r.n_runs > 0 for r in got) > 100
    key = lambda r: (r[0] is None, r[0], r[6])
    assert sorted(map(tuple, got), key=key) == sorted((expected_runs(*r) for r in rows), key=key)


def test_runs_of_any_grid():
    rng = random.Random(9)
    for _ in range(400):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        w = [c for c in w for _ in range(rng.choice([1, 1, 5]))]
        assert op13_runs.runs_of(np.array([ord(c) for c in w], np.int64)) == brute(w)


def test_false_hashes_are_told(monkeypatch):
    w = np.array([1, 2, 1, 2, 1, 2, 1, 2, 3, 3, 3, 3, 3, 3, 4, 5], np.int64)
    expect = brute(w.tolist())
    monkeypatch.setattr(op13_runs, "BASES", (0, 1))  # all words but the first hash to nothing; order is lost
    assert op13_runs.runs_of(w) == expect


def test_grids_come_in_slices(monkeypatch):
    w = np.array([k % 11 for k in range(500)] + [7] * 500, np.int64)
    expect = op13_runs.runs_of(w)
    monkeypatch.setattr(op13_runs, "POINTS", 5)
    assert op13_runs.runs_of(w) == expect == brute(w.tolist())


def test_empty_tables(spark):
    assert op13_runs.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert op11_variants.word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- earlier operators: cases that were wrong


def test_texts_without_a_common_run_are_no_copies(spark):
    """Words by a Thue-Morse pattern and by its complement: sums over places agree for any base modulo 2^64."""
    from tidewatch.llm import op4_bagminhash

    bit = lambda k: k.bit_count() & 1
    text = lambda flip: " ".join(("alpha", "beta")[bit(k // 5) ^ flip] if k % 5 == 0 else f"w{k}" for k in range(5120))
    rows = spark.createDataFrame([(1, text(0)), (2, text(1)), (3, text(0).replace(" ", "\n"))], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in op4_bagminhash.classes(rows).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_pre_split_is_the_librarys_for_all_code_points():
    from tokenizers import Tokenizer

    from tidewatch.llm import op3_bpe

    path = P.path("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path).pre_tokenizer, op3_bpe.codec(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    probe = lambda c: f"a{c}b 1{c}2 {c}'s"
    for k in range(0, len(points), 1000):
        text = "\n".join(map(probe, points[k : k + 1000]))
        assert codec.split(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]
    old = [c for c in points if c.isascii() or not codec.later.search(c)]
    for k in range(0, len(old), 1000):  # by the pattern alone
        text = "\n".join(map(probe, old[k : k + 1000]))
        assert codec.plain(text) == [text[a:b] for _, (a, b) in library.pre_tokenize_str(text)]


def test_files_and_scans_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, empty texts and empty tables through the file format, the licence scan and packing."""
    from tokenizers import Tokenizer

    from tidewatch.llm import op1_packing, op9_simple8b, op10_licences, stages

    rows = [(None, "no id here"), (5, "two words"), (5, "two words"), (5, "another text"), (6, None), (7, ""), (None, "no id here"), (8, "long " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, start string, part string").repartition(3)
    path = P.path("word_bpe_49k.json")
    op9_simple8b.write_files(docs, path, f"{tmp_path}/ids", 2, partitions=3)
    got = op9_simple8b.read_files(spark, f"{tmp_path}/ids").collect()
    library = Tokenizer.from_file(path)
    want = Counter((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
    assert [r.doc_id for r in ordered] == [None, None, 5, 5, 5, 6, 7, 8]
    op9_simple8b.write_files(docs.limit(0), path, f"{tmp_path}/none", 2)
    assert op9_simple8b.read_files(spark, f"{tmp_path}/none").collect() == []
    pieces = stages.packing_stage(spark, docs, "").collect()
    lengths = Counter()
    for r in pieces:
        lengths[r.doc_id] += r.length
    encode = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode
    assert lengths[5] == 3 + sum(len(encode(t, add_special_tokens=False).ids) for i, t in rows if i == 5)
    assert lengths[6] == lengths[7] == 1 and lengths[None] == 2 * next(r.doc_tokens for r in pieces if r.doc_id is None)
    assert stages.packing_stage(spark, docs.limit(0), "").collect() == [] and op1_packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).collect() == []
    found = op10_licences.scan(docs.union(spark.createDataFrame([(None, "Released under the MIT License.", "", "")] * 2, docs.schema))).collect()
    assert len(found) == 10 and sum(r.doc_id is None and r.n_license_lines == 1 for r in found) == 2 and sum(r.license is not None for r in found) == 2
    assert op10_licences.scan(docs.limit(0)).collect() == []


def test_what_wrappers_hold_is_told_apart(spark):
    """Sidebars, notices, forms and comments inside a main element or an article go; an article's own sections stay; loosely named ones go where the neighbour shares them."""
    from tidewatch.llm import op5_pages

    text = lambda page: op5_pages.main_text(op5_pages.lines(page), None)
    for extra in ('<div class="sidebar">', '<div class="related-posts">', '<div class="newsletter-signup">', '<section class="user-comments">', '<div class="comments-area">', '<div id="respond">', '<div class="cookie-banner">', '<div class="notice">', '<div class="sponsored">'):
        end = "</section>" if "section" in extra else "</div>"
        for wrapper in ("main", "article"):
            assert text(f"<{wrapper}><h1>Title</h1><p>Body</p>{extra}<p>extra</p>{end}<p>More</p></{wrapper}>") == "Title\nBody\nMore", extra
        assert text(f"<main><article><p>Body</p>{extra}x{end}</article>{extra}<p>y</p>{end}</main>") == "Body"
    kept = '<article><section id="notice"><p>On notices</p></section><div class="legal-history"><p>Laws</p></div><section class="post-content"><p>Body</p></section></article>'
    assert text(kept) == "On notices\nLaws\nBody"
    page = '<main><div class="menu-like"><p>Site menu</p></div><article><p>{0}</p><div class="copyright"><p>All rights</p></div><div class="social"><p>Only {0}</p></div></article><p>A standfirst beside it, {0}</p><p>Foot</p></main>'
    rows = [(1, "http://h.x/a", page.format("first")), (2, "http://h.x/b", page.format("second"))]
    got = {r.page_id: r.text for r in op5_pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "first\nOnly first\nA standfirst beside it, first", 2: "second\nOnly second\nA standfirst beside it, second"}
