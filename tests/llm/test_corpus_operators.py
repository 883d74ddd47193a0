"""The corpus operators against brute force, libraries and round trips."""

import hashlib
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from lodestone.llm import bpe, chat, common, dac, decon, exact, html, near, quality, shard, unigram  # noqa: E402

HARD = ["", " ", "  ", "a  b", " a", "a ", "a   b\n\n  c \n d", "x\xa0y   z", "\x1c a\x1c b", "don't I'LL 12345 ½ ²", "é" * 200, "a" * 3000, "<|endoftext|>hi <|ENDOFTEXT|>", "ß ǅ İ Σς ΣΑΣ", "日本語 テスト", "J̌ ǰ Å Å", None, "\x0b\x0c \x85 q", "🙂👍🏽 ok", "0 a0 0.0", "it's,fine.now", "…. a…b", "a\0b, c\0"]


def texts(seed=1, n=1500):
    rng = random.Random(seed)
    letters = "ab c\n\t .,!'ésé\xa0　\x1f1²"
    return HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts)]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# ---- 1 ----

@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool:x\\", "", "### User: "])
def test_chat_round_trip(role):
    for text in [x or "" for x in HARD] + [r"\### Assistant: </turn> ok", "</turn>", "\\", "### =a: </turn>\n", "</turn>\n### User: x", "\\</turn>", "### Us"]:
        rendered = chat.render(role, text)
        assert [t[:2] for t in chat.parse(rendered * 2)] == [(role, text)] * 2
        start, end = chat.parse(rendered)[0][2:]
        assert chat.ESCAPED.sub(r"\1", rendered[start:end]) == text


def test_chat_ties_go_by_text(spark):
    rows = [(1, 0, "user", t) for t in ("a", "a!", "a\\", "a<", "</turn>", "### User: ", "é", "🙂", "\ufffd")]
    turns = frame(spark, rows, "conv_id long, turn long, role string, text string")
    got = chat.chat_digest(chat.format_chats(turns)).first()
    want = "".join(f"user\n{t}\n" for t in sorted((r[3] for r in rows), key=str.encode))
    assert got["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", "b</turn>"), (1, 0, "user", None), (2, 0, "assistant", "x\\y"), (2, 0, "assistant", "x\\y"), (None, None, None, "é"), (3, 0, "tool", "### User: ")]
    turns = frame(spark, rows, "conv_id long, turn long, role string, text string")
    for chunk in (1, 1 << 20):
        got = {r["conv_id"]: r for r in chat.chat_digest(chat.format_chats(turns, chunk)).collect()}
        assert got[1]["n_turns"] == 2 and got[1]["turns_sha256"] == hashlib.sha256("user\n\nassistant\nb</turn>\n".encode()).hexdigest()
        assert got[1]["loss_chars"] == 8 and got[1]["loss_sha256"] == hashlib.sha256(b"b</turn>").hexdigest()
        assert got[2]["loss_chars"] == 6 and got[None]["loss_chars"] == 0 and got[3]["n_turns"] == 1
    assert chat.chat_digest(chat.format_chats(turns.limit(0))).count() == 0


# ---- 2 ----

def bag(text, k=5):
    words = decon.words_of(text or "")
    out = {}
    for i in range(max(1, len(words) - k + 1)) if words else []:
        s = tuple(words[i : i + k])
        out[s] = out.get(s, 0) + 1
    return out


def jaccard(a, b):
    common_ = sum(min(v, b.get(s, 0)) for s, v in a.items())
    return common_ / max(1, sum(a.values()) + sum(b.values()) - common_)


def near_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(120)]
        for copy in range(rng.choice([1, 2, 5, 30])):
            other = list(base)
            for _ in range(rng.randint(0, 3) if copy else 0):
                other[rng.randrange(len(other))] = word()
            rows.append((n, " ".join(other)))
            n += 1
    chain = [word() for _ in range(200)]
    for _ in range(15):  # each near the one before, not near the first
        chain = list(chain)
        for _ in range(3):
            chain[rng.randrange(len(chain))] = word()
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "!!"), (n + 3, "one two"), (n + 4, "One, two!"), (n + 5, "ha " * 40), (n + 6, "ha " * 44), (n + 6, "ha " * 44), (None, rows[0][1])]
    return rows


def test_near_classes_match_brute_force(spark):
    rows = near_rows()
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8) or (not bags[i] and not bags[j] and (rows[i][1] or "") == (rows[j][1] or "")):
                parent[root(i)] = root(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(root(i), []).append(d)
    want = sorted((d is None, d or 0, min(x for x in c if x is not None), len(c)) for c in classes.values() for d in c)
    for some, words, size in ((8, 1 << 18, 1 << 9), (2, 500, 7)):
        near.FEW, near.BLOCK_WORDS, near.BLOCK_NODES = some, words, size
        got = near.near_classes(frame(spark, rows)).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"], r["class_size"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(classes)
    near.FEW, near.BLOCK_WORDS, near.BLOCK_NODES = 8, 1 << 18, 1 << 9


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
def test_near_finds_all_links_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    bags = {r["doc_id"]: bag(r["text"]) for r in rows}
    ids = sorted(bags)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8]
    of = {r["doc_id"]: r["class_id"] for r in near.near_classes(docs).collect()}
    found = sum(of[a] == of[b] for a, b in links)
    assert links and found == len(links)  # recall 1.0
    linked = {x for pair in links for x in pair}
    assert all(of[d] == d for d in ids if d not in linked and bags[d])  # and nothing else is joined


def test_drop_near_tells_rows_apart_by_text(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    long = lambda: [word() for _ in range(120)]
    near_copy = lambda base: " ".join([*base[:-1], "zzzz"])
    a, b, c, d, e, f, g = (long() for _ in range(7))
    join = " ".join
    rows = [
        (None, join(a), "x"), (None, join(b), "x"), (None, near_copy(a), "x"),  # no id: two texts, one near copy
        (7, join(c), "x"), (7, join(d), "x"), (7, near_copy(c), "x"),  # a repeated id: the same
        (1, join(e), "x"), (9, near_copy(e), "x"), (9, join(f), "x"),  # 9 is dropped for one text, kept for the other
        (None, near_copy(g), "x"), (4, join(g), "x"),  # a near copy without id falls to the one that has an id
        (8, "lone text", "x"), (8, "lone text", "y"), (None, "no id", "x"), (None, "no id", "y"), (None, None, "x"), (None, "", "y"), (6, "one, two", "x"), (6, "One two", "x"),
    ]
    docs = frame(spark, rows, "doc_id long, text string, class_id string")
    out = near.drop_near(docs)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in out.collect()]
    either = lambda i, base: sum((i, t) in got for t in (join(base), near_copy(base)))
    assert either(None, a) == 1 and either(7, c) == 1
    assert sum(x in got for x in ((6, "one, two"), (6, "One two"))) == 1
    sure = [(None, join(b)), (7, join(d)), (1, join(e)), (9, join(f)), (4, join(g)), (8, "lone text"), (None, "no id"), (None, "")]
    assert all(got.count(x) == 1 for x in sure) and len(got) == len(sure) + 3
    flags = near.near_classes(docs.select("doc_id", "text")).collect()
    assert len(flags) == len(rows) and sum(r["kept"] for r in flags) == len(got)


def test_near_hot_id_is_no_product_of_its_texts(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(40)]
    rows = [(5 if i % 2 else None, " ".join([*b, *["end"] * k])) for i, b in enumerate(base) for k in range(4)] * 3
    got = near.drop_near(frame(spark, rows)).collect()
    assert sorted(r["text"].split()[0] for r in got) == sorted(b[0] for b in base)


def test_bag_signatures_are_unbiased():
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    for changes in (2, 8, 20):
        other = list(base)
        for _ in range(changes):
            other[rng.randrange(200)] = f"z{rng.randrange(5)}"
        for a, b in ((" ".join(base), " ".join(other)), (" ".join(["a b c d e"] * 30 + base), " ".join(["a b c d e"] * 44 + base))):
            doc, s, w, _ = near.bags(pa.array([a, b]))
            sig = near.signatures(doc, s, w, 2, 4096)
            assert abs((sig[0] == sig[1]).mean() - jaccard(bag(a), bag(b))) < 0.04


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7)], "a long, b long")
    roots = near.components(edges)
    assert {r["node"]: r["root"] for r in roots.collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}
    more = spark.createDataFrame([(6, 9), (11, 12)], "a long, b long")
    assert {r["node"]: r["root"] for r in near.merged(roots, more).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 1, 6: 1, 11: 11, 12: 11}


# ---- 3 ----

def test_shards(spark):
    df = spark.range(3000).select("id")
    rows = shard.assign_shards(df, "id", [1.0] * 8, [1.0] * 9).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert max(sum(r["shard"] == i for r in rows) for i in range(8)) < 460
    heavy = shard.assign_shards(df, "id", [1.0, 3.0], [1.0, 3.0, 2.0]).collect()
    assert abs(sum(r["shard"] for r in heavy) / 3000 - 0.75) < 0.04 and all(r["grown_shard"] in (r["shard"], 2) for r in heavy)


def test_slots_are_gapless_with_repeats(spark):
    rows = [(7, "a")] * 50 + [(None, None)] * 3 + [(i, "é" * i) for i in range(40)]
    df = frame(spark, rows)
    from pyspark.sql import functions as F

    keyed = shard.assign_shards(df.select("doc_id", F.octet_length("text").alias("size")), "doc_id", [1.0] * 3)
    got = shard.shard_slots(keyed, ["doc_id", "size"]).collect()
    assert len(got) == len(rows)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


# ---- 4 ----

@pytest.mark.parametrize("top", [1, 200, 256, 70000, 2**32 - 1])
def test_codes(top):
    ids = np.random.default_rng(top).integers(0, top, 3001).astype(np.uint32)
    chunks, more, ranks = dac.dac_encode(ids)
    assert (dac.dac_decode(chunks, more) == ids).all()
    assert [dac.dac_get(chunks, more, ranks, i) for i in range(len(ids))] == ids.tolist()
    for a, z in ((0, 3001), (0, 0), (3001, 3001), (7, 8), (511, 513), (1000, 2999), (3000, 3001)):
        assert dac.dac_range(chunks, more, ranks, a, z).tolist() == ids[a:z].tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_the_library(name, monkeypatch):
    import tokenizers

    path = P.path(name)
    some = texts()
    monkeypatch.setattr(dac, "KNOWN", 300)
    coder = dac.Pieces(path)
    assert coder.by_words == (name == "word_bpe_49k.json")
    got = [x for a in range(0, len(some), 100) for x in split(*coder(pa.array(some[a : a + 100], pa.string())))]
    assert got == [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch([x or "" for x in some], add_special_tokens=False)]


def test_token_file(spark):
    import tokenizers

    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, "again"), (None, "no id")]
    path = common.new_path(spark, "tokens-test")
    dac.write_tokens(frame(spark, rows), path, P.path("word_bpe_49k.json"), 2, segment_tokens=50)
    tok = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    start = 0
    want = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "") if r[1] is not None else "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in dac.token_index(spark, path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_token_at_reads_a_written_file(spark):
    import tokenizers

    rows = [(i, f"{t or ''} word{i}") for i, t in enumerate(HARD)]
    path = common.new_path(spark, "tokens-at")
    dac.write_tokens(frame(spark, rows), path, P.path("word_bpe_49k.json"), 2, segment_tokens=50)
    tok = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [x for _, t in rows for x in [*tok.encode(t, add_special_tokens=False).ids, 2]]
    got = dac.token_at(spark, path, [*range(len(ids)), -1, len(ids), 3]).collect()
    assert sorted(tuple(r) for r in got) == list(enumerate(ids))
    assert dac.token_at(spark, path, []).count() == 0


# ---- 5 ----

@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        (None, ""),
        ("<p>a<p>b<br>c", "a\n\nb\nc"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
        ("<table><tr><th>k<th>val<tr><td>long key<td>1<td hidden>z</table>", "k        | val\nlong key | 1"),
        ("x<script>if(a<b)</script><style>p{}</style><!-- c -->y", "xy"),
        ("<div style='color:red; display : none'>no</div><p hidden>no</p>5 < 6 &lt; 7 &amp; <b>b</b>", "5 < 6 < 7 & b"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("<div>a<div>b</div>c</div></p>d", "a\nb\nc\n\nd"),
        ("a<img alt='pic'> <a href='x>y'>z</a", "apic z"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
        ("<" * 50, "<" * 50),
        ("<div>" * 3000 + "deep", "deep"),
        ("<title>t</title><textarea>a<b></textarea>", "a<b>"),
    ],
)
def test_html(page, want):
    assert html.render_html(page or "") == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b", "a x=2 b"),
        ("<svg><defs/><path d='M0'/><title>t</title><defs><text>no</text></defs><text>one</text><text>two</text></svg>z", "one\ntwo\nz"),
        ("<select><option>a<option selected>b<optgroup label=G><option>c</select>d", "a\nb\nG\nc\nd"),
        ("<map name=m>in a map</map>", "in a map"),
        ("<object>fallback</object><object data=x>unseen</object>", "fallback"),
        ("<dialog open>seen</dialog><dialog>closed</dialog>", "seen"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no<img alt=no></div>on", "yes\non"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A | b\n  | c\nd | e"),
        ("<table><tr><td>a<td rowspan=0 colspan=2>b<tr><td>c<tr><td>d<td>e</table>", "a | b\nc\nd |  |  | e"),
    ],
)
def test_html_keeps_what_browsers_show(page, want):
    assert html.render_html(page) == want


def test_html_takes_deep_pages():
    began = time.time()
    deep = html.render_html("<div>" * 60000 + "<p>a<div>b" + "</div>" * 60000 + "c")
    assert deep == "a\n\nb\nc" and time.time() - began < 20
    lists = html.render_html("<ul><li>x" * 20000)
    assert lists.count("x") == 20000 and len(lists) < 20000 * 90


def test_html_keeps_all_words(spark):
    rows = [(1, "<p>a <b>b</b>c</p>"), (1, "<p>a <b>b</b>c</p>"), (2, None), (3, "plain")]
    got = html.extract_html(frame(spark, rows, "page_id long, html string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a bc"), (1, "a bc"), (2, ""), (3, "plain")]


# ---- 6 ----

def test_bpe_equals_the_library():
    import tiktoken

    b = bpe.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    some = [*texts(), "ab" * 400 + "🙂" * 90, "x" * 47, "xyz" * 16, "xyz" * 17]
    got = split(*b(pa.array(some, pa.string())))
    assert got == [lib.encode_ordinary(x or "") for x in some]
    assert all(b.decode(i) == (x or "").encode() for i, x in zip(got, some))


def test_native_words_equal_the_fold(spark):
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    words = [b"", b"a", b" the", b" thntblere", "ciónado".encode(), b"zzzzqx", b"!!!!!!!"]
    got = {bytes(r["word"]): r["ids"] for r in bpe.native_words(spark.createDataFrame([(w,) for w in words], "word binary"), ranks).collect()}
    assert got == {w: bpe.fold_merges(w, ranks) if w else [] for w in words}


def test_bpe_digest(spark):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (2, None)]
    got = sorted(tuple(r) for r in bpe.bpe_digest(frame(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    assert got[0] == got[1] and got[2][1] == 0 and got[2][3] == hashlib.sha256(b"").hexdigest()
    assert got[0][3] == hashlib.sha256(b"Hello  world").hexdigest()


# ---- 7 ----

def test_trie():
    rng = random.Random(3)
    trie, want = exact.PatriciaTrie(), {}
    for _ in range(4000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        trie.add(key, owner := rng.randint(0, 99), 1, 1)
        want.setdefault(key, []).append(owner)
    want = {k: [max(v), len(v), v.count(max(v))] for k, v in want.items()}
    assert dict(trie.spill()) == want and trie.bytes == 0


def test_trie_spills_complete_subtrees_in_byte_order():
    rng = random.Random(4)
    keys = sorted(bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 7))) for _ in range(3000))
    trie, got, most = exact.PatriciaTrie(), [], 0
    for i, key in enumerate(keys):
        trie.add(key, i, 1, 1)
        most = max(most, trie.bytes)
        if trie.bytes > 60:
            got += trie.spill_before(key)
    got += trie.spill()
    assert len(got) == len(dict(got)) == len(set(keys)) and most < 100 and trie.bytes == 0
    assert all(v == [max(i for i, k in enumerate(keys) if k == key), keys.count(key), 1] for key, v in got[:200])
    shared = exact.PatriciaTrie()  # common beginnings are stored once
    for i in range(50):
        shared.add(b"x" * 1000 + str(i).encode(), i, 1, 1)
    assert shared.bytes < 1200


def test_stages_keep_columns_of_any_name(spark):
    names = ["sha", "SHA_", "__id", "key", "id", "copies", "owned", "a.b", "own", "body"]
    rows = [(1, "one two three", *"abcdefghij"), (2, "one two THREE", *"bcdefghijk"), (2, "one two THREE", *"bcdefghijk"), (None, None, *"cdefghijkl")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for stage in (exact.drop_copies, near.drop_near):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() == 2


def test_exact_groups(spark):
    rows = [(1, "Abc É"), (2, "aBC É"), (3, "abc é"), (4, None), (5, ""), (5, ""), (None, "z"), (None, "z"), (9, "z" * 70000), (8, "z" * 70000)]
    wide = frame(spark, rows).selectExpr("*", "1 AS keep_id", "'x' AS hash")
    got = exact.exact_groups(wide).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 5
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert (by[1]["keep_id"], by[1]["group_size"], by[3]["keep_id"], by[4]["keep_id"], by[5]["group_size"], by[9]["keep_id"], by[None]["keep_id"]) == (2, 2, 3, 5, 3, 9, None)
    assert by[1]["text_sha256"] == hashlib.sha256("abc É".encode()).hexdigest()
    kept = exact.drop_copies(wide)
    assert kept.columns == wide.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "5", "9", "None"]
    assert exact.exact_groups(wide.limit(0)).count() == 0


# ---- 8 ----

def brute_hits(words, items, window):
    wins = {}
    for item, ws in items:
        for k in range(max(1, len(ws) - window + 1)) if ws else []:
            wins.setdefault(tuple(ws[k : k + window]), set()).add(item)
    hit, named = set(), set()
    for k in range(len(words)):
        for n in {len(w) for w in wins}:
            if k + n <= len(words) and tuple(words[k : k + n]) in wins:
                hit.update(range(k, k + n))
                named |= wins[tuple(words[k : k + n])]
    return hit, named


def test_automaton_finds_all_windows():
    rng = random.Random(7)
    for _ in range(1500):
        items = [(str(i), [rng.choice("abc").encode() for _ in range(rng.randint(0, 7))]) for i in range(rng.randint(0, 5))]
        window = rng.randint(1, 4)
        docs = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(3)]
        half = len(items) // 2
        blocks = [decon.Benchmark(items[:half], window), decon.Benchmark(items[half:], window)]
        counts, mask, found = decon.hits(pa.array(docs), blocks)
        at = 0
        for j, d in enumerate(docs):
            words = [w.encode() for w in d.split()]
            hit, named = brute_hits(words, items, window)
            assert set(np.flatnonzero(mask[at : at + counts[j]]).tolist()) == hit and found.get(j, set()) == named
            at += counts[j]


def test_words_follow_the_pattern():
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for t in texts():
        want = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert [w.decode() for w in decon.words_of(t or "")] == want


def test_decontaminate(spark):
    item = " ".join(f"w{i}" for i in range(14))
    bench = spark.createDataFrame([(1, item), (2, "Short one"), (3, None), (2, "Short one"), (4, "!")], "item_id long, text string")
    rows = [(1, f"Before. {item.upper()}, after it " + "more words " * 20), (2, "a short, ONE here"), (3, None), (4, item), (5, "clean text"), (5, "clean text")]
    got = {r["doc_id"]: r for r in decon.find_hits(frame(spark, rows), bench).collect()}
    assert (got[1]["n_hit"], got[2]["n_hit"], got[3]["n_words"], got[4]["n_hit"], got[5]["contaminated"]) == (14, 2, 0, 14, False)
    assert got[2]["items_sha256"] == hashlib.sha256(b"2").hexdigest() and got[5]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = decon.remove_spans(frame(spark, rows).selectExpr("*", "cast(0 AS long) AS n_chars"), bench, length_col="n_chars").collect()
    by = {r["doc_id"]: r for r in clean}
    assert 4 not in by and len(clean) == 5 and "w3" not in by[1]["text"].lower() and by[1]["n_chars"] == len(by[1]["text"]) and by[5]["text"] == "clean text"
    again = decon.find_hits(spark.createDataFrame([(r["doc_id"], r["text"]) for r in clean], "doc_id long, text string"), bench)
    assert again.where("contaminated").count() == 0
    # a test set that takes several passes gives the same
    for small in (1, 20):
        parts = decon.find_hits(frame(spark, rows), bench, pass_bytes=small).collect()
        assert sorted(map(str, parts)) == sorted(map(str, decon.find_hits(frame(spark, rows), bench).collect()))
        in_parts = decon.remove_spans(frame(spark, rows).selectExpr("*", "cast(0 AS long) AS n_chars"), bench, length_col="n_chars", pass_bytes=small).collect()
        assert sorted(map(str, in_parts)) == sorted(map(str, clean))


# ---- 9 ----

def test_counts_equal_the_library():
    import tokenizers

    path = P.path("piece_bpe_32k.model")
    vocabulary = unigram.load_pieces(path)
    lib = tokenizers.Tokenizer(tokenizers.models.Unigram([*vocabulary, ("<unk>", -1.0)], unk_id=len(vocabulary), byte_fallback=False))
    some = [x for x in texts() if "▁" not in (x or "")]
    counts, _ = unigram.Unigram(vocabulary)(pa.array(some, pa.string()))
    for text, count in zip(some, counts):
        marked = "▁" + text.replace(" ", "▁") if text else ""
        e = lib.encode(marked)
        assert count == sum(1 if i != len(vocabulary) else len(marked[a:b].encode()) for i, (a, b) in zip(e.ids, e.offsets))


def test_counts_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        vocabulary = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 3))): float(rng.randint(-4, 0)) for _ in range(6)}
        model = unigram.Unigram(list(vocabulary.items()))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))
        marked = "▁" + text.replace(" ", "▁") if text else ""
        best = [(0.0, 0)] + [None] * len(marked)
        for e in range(1, len(marked) + 1):
            for s in range(e):
                piece = marked[s:e]
                score = vocabulary.get(piece, model.unknown if e - s == 1 else None)
                if score is not None and (best[e] is None or best[s][0] + score > best[e][0]):
                    best[e] = (best[s][0] + score, best[s][1] + (1 if piece in vocabulary else len(piece.encode())))
        counts, scores = model(pa.array([text]))
        assert (scores[0], counts[0]) == best[len(marked)]


def test_count_tokens_of_odd_rows(spark):
    path = P.path("piece_bpe_32k.model")
    rows = [(1, "a plain text"), (1, "a plain text"), (None, "two  spaces "), (2, None), (3, ""), (4, "long " * 50000 + "▁end")]
    plain = unigram.Unigram(unigram.load_pieces(path))
    whole = lambda t: plain.count("▁" + t.replace(" ", "▁")) if t else (0, 0.0)
    got = unigram.count_tokens(frame(spark, rows), path).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, *whole(t))) for d, t in rows)


def test_operators_take_empty_tables_and_clashing_names(spark):
    """op1, op3, op4, op5 and op9 with no rows, and beside columns that have the names they use themselves."""
    from pyspark.sql import functions as F

    docs = frame(spark, [(1, "a b"), (1, "a b"), (None, None)])
    docs = docs.withColumns({c: F.lit("x") for c in ("key", "n", "part", "segment", "n_tokens", "score", "shard", "total", "base", "first", "html", "role")})
    turns = docs.select("*", F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("x").alias("rendered"), F.lit("x").alias("lead"))
    weighted = lambda d: shard.assign_shards(d.drop("shard"), "doc_id", [1.0] * 3)
    words = P.path("word_bpe_49k.json")

    def tokens(d):
        path = common.new_path(spark, "tokens-odd")
        dac.write_tokens(d, path, words, 2)
        assert dac.token_at(spark, path, [0, 10**9]).count() == (0 if d.isEmpty() else 1)
        return dac.token_index(spark, path)

    runs = [
        lambda d: unigram.count_tokens(d, P.path("piece_bpe_32k.model")),
        lambda d: shard.shard_slots(weighted(d), ["doc_id", "text"]),
        tokens,
        lambda d: html.extract_html(d.drop("html").withColumnRenamed("text", "html"), "doc_id"),
    ]
    for run in runs:
        assert run(docs).count() == 3 and run(docs.limit(0)).count() == 0
    assert chat.chat_digest(chat.format_chats(turns)).count() == 2 and chat.chat_digest(chat.format_chats(turns.limit(0))).count() == 0


# ---- 10 ----

def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 90))).capitalize() + "."
    rows = [(i, good() if i % 3 else "!! ".join(good().upper().split())) for i in range(600)] + [(600, None), (601, ""), (5, "again")]
    labels = [(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (3, None), (6, 0), (6, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.score_quality(frame(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and not math.isnan(r["score"]) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in out) / len(out) > 0.97
    flat = quality.score_quality(frame(spark, rows), table.limit(0)).collect()
    assert {r["score"] for r in flat} == {0.5}
    # labels of held-out rows change nothing
    wrong = [(d, 1 - q if d is not None and q is not None and zlib.crc32(str(d).encode()) % 3 == 1 else q) for d, q in labels]
    same = quality.score_quality(frame(spark, rows), spark.createDataFrame(wrong, "doc_id long, quality int")).collect()
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in got) == sorted((r["doc_id"], round(r["score"], 9)) for r in same)
