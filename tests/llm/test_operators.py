"""Each operator against a brute-force version, on texts with nulls, empty and long ones, ties and repeated rows."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def texts(seed=3, n=60, vocabulary=400):
    """Random texts with exact and near copies, shared passages, nulls, empty ones and one long one."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passage = " ".join(word() for _ in range(40))
    out = []
    for k in range(n):
        t = " ".join(word() for _ in range(r.choice([3, 30, 80])))
        if k % 7 == 3:
            t = t + " " + passage + "\n" + t[:20]
        if k % 9 == 5 and out[-1]:
            t = out[-1]
        if k % 9 == 7 and out[-1]:
            words = out[-1].split()
            words[len(words) // 2] = "changed"
            t = " ".join(words)
        out.append(t)
    out[10], out[20], out[30] = None, "", " \t\n"
    out[40] = " ".join(word() for _ in range(6000))
    return out


@pytest.fixture
def corpus(documents):
    t = texts()
    rows = [(k, x, "en", f"s{k % 3}") for k, x in enumerate(t)]
    rows += [rows[5], rows[5], (None, t[6], None, None)]
    return rows, documents(rows, clash=("size", "block", "n", "component_id", "row"))


def test_jaccard_join(corpus):
    from petrel.llm.ngram_join import join

    rows, df = corpus
    sets = defaultdict(set)
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").lower())
        sets[i] |= {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None and sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = sorted(((i, len(sets[i]), root(i) if i is not None else None) for i, *_ in rows), key=str)
    got = rows_of(join(df), "doc_id", "n_shingles", "component_id")
    assert got == want
    assert len({c for _, _, c in got}) < len(got) - 5


def test_jaccard_join_of_nothing(documents):
    from petrel.llm.ngram_join import join

    assert join(documents([])).count() == 0


@pytest.mark.parametrize("rows_a_block", [512, 3])
def test_jaccard_join_counts_links(corpus, documents, monkeypatch, rows_a_block):
    from petrel.llm import ngram_join

    monkeypatch.setattr(ngram_join, "CELL_ROWS", rows_a_block)
    r, rows = random.Random(8), list(corpus[0])
    base = [f"b{k}" for k in range(200)]
    for k in range(40):  # a group of near copies, not all of which link
        changed = set(r.sample(range(200), r.randrange(1, 7)))
        rows.append((200 + k, " ".join("x" if j in changed else w for j, w in enumerate(base)), "en", "s"))
    rows += [(300 + k, rows[-1][1], "en", "s") for k in range(3)] + [(200, "another text of the id, which is far from it", "en", "s")]
    sets = []
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").lower())
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    others = {x for x in sets if x[0] is not None and x[1]}
    meets = lambda x, y: x != y and 100 * len(x[1] & y[1]) >= 80 * len(x[1] | y[1])
    want = [(x[0], len(x[1]), sum(meets(x, y) for y in others) if x in others else 0) for x in sets]
    group = [n for i, _, n in want if (i or 0) >= 200]
    assert max(group) > 10 and len(set(group)) > 5
    assert rows_of(ngram_join.join(documents(rows)), "doc_id", "n_shingles", "n_links") == sorted(want, key=str)


def test_prefix_lengthens_with_cost():
    from petrel.llm.ngram_join import prefix_of

    runs, none = np.arange(1000, dtype=np.uint64), (np.empty(0, np.uint64), np.empty(0, np.int64))
    short, one = prefix_of(runs, *none, 0.0)
    long, many = prefix_of(runs, *none, 0.5)
    assert (len(short), one) == (201, 1) and many > 1 and len(long) == 200 + many
    frequent = np.array([3, 4], np.uint64)
    assert not set(frequent) & set(prefix_of(runs, frequent, np.array([9, 9]), 0.0)[0])


@pytest.mark.parametrize("block_bytes", [1 << 30, 300])
def test_substring_dedup(corpus, block_bytes):
    from petrel.llm.substring_dedup import digest, parse

    rows, df = corpus
    seen, want = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w, gone = WORDS.findall(t or ""), set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone.update(range(k, k + 20))
            seen.add(tuple(w[k : k + 20]))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    out = parse(df, block_bytes)
    got = rows_of(out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("s")), "doc_id", "n_words", "n_removed", "s")
    assert got == sorted(want, key=str)
    assert sum(s["length"] for r in out.collect() for s in r.spans) == sum(r[2] for r in want) > 100
    assert digest(df.limit(0)).count() == 0


def test_word_hashes(monkeypatch):
    from petrel.llm import common

    r = random.Random(4)
    some = [None, b"", b" \t", b"a", b"a b", *[" ".join(r.choice(["x", "yy", "\xe9t\xe9", "\n", "\x1c"]) for _ in range(r.randrange(60))).encode() for _ in range(80)], b"z" * 70 + b" a"]
    by = {}
    for most in (1 << 20, 50, 7):
        monkeypatch.setattr(common, "HASHED_BYTES", most)
        got, n = common.word_hashes(some)
        words = [(t or b"").split() for t in some]
        assert n.tolist() == [len(w) for w in words]
        for w, h in zip([x for w in words for x in w], got.tolist(), strict=True):
            assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def brute_removed(rows):
    """{(doc_id, text): covered words} by the contract."""
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w, gone = WORDS.findall(t or ""), set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone.update(range(k, k + 20))
            seen.add(tuple(w[k : k + 20]))
        out.append((i, len(w), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 30, 300])
def test_factors_name_their_sources(corpus, block_bytes):
    from petrel.llm.substring_dedup import Block, blocked, parse

    rows, df = corpus
    by = defaultdict(list)
    for r in blocked(df, block_bytes).collect():
        by[r.block].append(r)
    import pyarrow as pa

    words = {}
    for k, some in by.items():
        b = Block(pa.table({"doc_id": pa.array([r.doc_id for r in some], pa.int64()), "text": pa.array([r.text for r in some], pa.string())}))
        words[k] = [w for t in b.texts for w in (t or b"").decode().split()]
    checked = 0
    for r in parse(df, block_bytes).select("doc_id", "n_removed", "spans", "factors").collect():
        texts = [WORDS.findall(t or "") for i, t, *_ in rows if i == r.doc_id]
        covered = set()
        for f in r.factors:
            assert f.length >= 20
            assert any(t[f.start : f.start + f.length] == words[f.block][f.source : f.source + f.length] for t in texts)
            covered |= set(range(f.start, f.start + f.length))
            checked += 1
        assert len(covered) == r.n_removed and covered == {x for s in r.spans for x in range(s.start, s.start + s.length)}
    assert checked > 10


def test_substring_dedup_of_equal_hashes(monkeypatch):
    from petrel.llm import substring_dedup

    r = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k, " ".join(f"w{r.randrange(90)}" for _ in range(25)) + (" " + passage if k % 3 == 0 else ""), "en", "s") for k in range(12)]
    one = substring_dedup.ngrams
    # the first hash of a phrase says almost nothing; the second is left whole
    monkeypatch.setattr(substring_dedup, "ngrams", lambda words, n: one(words, n) % np.uint64(3) if n == 20 and not getattr(substring_dedup, "_second", False) else one(words, n))
    second = substring_dedup._check

    def check(words):
        substring_dedup._second = True
        try:
            return second(words)
        finally:
            del substring_dedup._second

    monkeypatch.setattr(substring_dedup, "_check", check)
    from petrel.llm.substring_dedup import Block
    import pyarrow as pa

    b = Block(pa.table({"doc_id": [i for i, *_ in rows], "text": [t for _, t, *_ in rows]}))
    found = substring_dedup.factors_of(b, 0, *[np.empty(0, np.int64)] * 3)
    gone = np.zeros(b.n, bool)
    for at, n, *_ in found:
        gone[at : at + n] = True
    assert [(i, int(n), int(gone[a : a + n].sum())) for i, a, n in zip(b.ids.tolist(), b.starts, b.lengths, strict=True)] == [x for x in sorted(brute_removed(rows), key=lambda x: x[0])]
    assert len({int(x) for x in b.phrases}) <= 3 < len(b.first)


def test_automaton_against_brute_force():
    from petrel.llm.decontaminate import Automaton

    r = random.Random(2)
    for _ in range(400):
        window, letters = r.choice([2, 3, 4]), [b"a", b"b", b"c"][: r.choice([2, 3])]
        items = [(i, [r.choice(letters) for _ in range(r.randint(1, 8))]) for i in range(r.randint(1, 5))]
        if r.random() < 0.3:
            items.append((99, list(items[0][1])))
        doc = [r.choice([*letters, b"z"]) for _ in range(r.randint(0, 20))]
        hit, want_hit, want = bytearray(len(doc)), bytearray(len(doc)), set()
        found = Automaton(items, window).scan(doc, hit)
        for i, w in items:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                for p in range(len(doc) - n + 1):
                    if doc[p : p + n] == w[k : k + n]:
                        want.add(i)
                        want_hit[p : p + n] = b"\x01" * n
        assert (hit, found) == (want_hit, want)


def test_decontamination(spark, documents):
    from petrel.llm.decontaminate import automata, clean, digest

    item = " ".join(f"q{k}" for k in range(12))
    bench = spark.createDataFrame([(1, item), (2, "Short one!"), (3, None), (4, "..."), (5, item)], "item_id long, text string")
    filler = " ".join(f"f{k}" for k in range(30))
    docs = documents([(1, f"{filler} {item.upper()}, end", "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (4, "a SHORT-one here", "en", "a"), (5, filler, "en", "a"), (6, item, "en", "a")], clash=("item_id", "items"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in digest(docs, bench).collect()}
    assert got == {1: (43, 12, 2, True), 2: (0, 0, 0, False), 3: (0, 0, 0, False), 4: (4, 2, 1, True), 5: (30, 0, 0, False), 6: (12, 12, 2, True)}
    left = {r.doc_id: r.text for r in clean(docs, bench).collect()}
    assert 6 not in left and left[1] == f"{filler} , end" and left[4] == "a SHORT-one here"
    assert digest(docs, bench.limit(0)).where("contaminated").count() == 0
    assert len(automata(bench, most_words=5)) == 3


def test_several_automata_give_one_result(spark, documents, monkeypatch):
    from petrel.llm import decontaminate

    bench = spark.createDataFrame([(k, " ".join(f"q{k}x{j}" for j in range(11))) for k in range(6)], "item_id long, text string")
    docs = documents([(k, " ".join(f"q{m}x{j}" for m in (k, k + 1) for j in range(11)), "en", "a") for k in range(5)])
    one = rows_of(decontaminate.digest(docs, bench), "doc_id", "n_hit", "items_sha256")
    whole = decontaminate.automata
    monkeypatch.setattr(decontaminate, "automata", lambda b, w: whole(b, w, most_words=20))
    assert rows_of(decontaminate.digest(docs, bench), "doc_id", "n_hit", "items_sha256") == one


def test_one_automaton_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from petrel.llm import common, decontaminate

    items = [[(k, [b"q%d" % j for j in range(k, k + 11)])] for k in range(3)]
    built = []
    monkeypatch.setattr(decontaminate, "_built", lambda x, window: built.append(x) or decontaminate.Automaton(x, window))
    texts = [" ".join(f"q{j}" for j in range(k, k + 12)) for k in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 4])], ["text"]) for k in range(0, 40, 4)]
    got = [f for _, _, found in decontaminate._scanned(iter(batches), items, "x", 10) for f in found]
    assert len(built) == 3 and len(common._KEPT) == 1 and got[0] == {0, 1, 2} and not got[30]
    common.forget()


def test_whole_documents_go_by_the_limits(spark, documents):
    from petrel.llm.decontaminate import clean

    item = " ".join(f"q{k}" for k in range(12))
    bench = spark.createDataFrame([(1, item), (2, "short one"), (None, "filler word one two three four five six seven eight")], "item_id long, text string")
    filler = "filler word one two three four five six seven eight nine " * 40
    docs = documents([(1, f"{filler} {item}", "en", "a"), (2, f"{filler} short one", "en", "a"), (3, "short one", "en", "a"), (4, None, "en", "a"), (2, f"{filler} short one", "en", "a")], clash=("row", "n_hit"))
    left = clean(docs, bench, whole=True)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 2, 4]


def test_join_without_broadcasts(corpus, monkeypatch):
    from petrel.llm import ngram_join

    want = rows_of(ngram_join.join(corpus[1]), "doc_id", "component_id", "n_links")
    monkeypatch.setattr(ngram_join, "MOST_IDS", 0)
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 1)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "CHUNK_RUNS", 100)
    assert rows_of(ngram_join.join(corpus[1]), "doc_id", "component_id", "n_links") == want


def test_mix_without_broadcasts(corpus, monkeypatch):
    from petrel.llm import mixing

    want = rows_of(mixing.mix(corpus[1]), "doc_id", "target", "taken")
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert rows_of(mixing.mix(corpus[1]), "doc_id", "target", "taken") == want


def test_token_files(corpus, spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from petrel.llm.token_files import read, read_document, write

    rows, df = corpus
    path, folder = P.path("byte_bpe_50k.json"), f"file://{tmp_path}"
    t = Tokenizer.from_file(path)
    want, start = [], 0
    for i, x, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    files = write(df, folder, path, file_bytes=4000)
    assert files.count() > 1
    got = sorted((tuple(r) for r in read(spark, folder, files, with_ids=True).collect()), key=lambda r: r[1])
    assert got == want
    name = files.orderBy("file").first().file
    assert [x.tolist() for x in read_document(folder, name, 1)] == [want[2][4]]
    assert write(df.limit(0), f"{folder}/none", path).count() == 0


def test_encoder_equals_the_library():
    import public_tokenizers as P

    from petrel.llm.token_files import Encoder

    e, r = Encoder(P.path("byte_bpe_50k.json")), random.Random(1)
    odd = ["a", "foo", " ", "  ", "\n", "\t", "\r\n", "'s", "12", "é", "\xa0", "\x1c", "!", "...", "漢字", "<|endoftext|>", "​", "\x85", "x,", "it's."]
    some = ["".join(r.choice(odd) for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["".join(r.choice(odd[:3] + odd[7:10]) for _ in range(9)) for _ in range(1000)]
    for text, got in zip(some, e.all(some, 0), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 0], text


def test_warc_round_trip(spark):
    from petrel.llm.warc import round_trip

    data = [(3, "http://a/x y\r\n", "same"), (1, "http://b/", "same"), (2, None, None), (4, "u", ""), (5, "u", "é" * 50000), (5, "u", "é" * 50000), (None, "u", "same"), (7, "u", "one")]
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, first string")
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    got = rows_of(round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {"same": None, "": 2, "é" * 50000: 5, "one": 7}
    want = [(p, len((h or "").encode()), digest(h), "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h in data]
    assert got == sorted(want, key=str)
    assert round_trip(df.limit(0)).count() == 0


def test_warc_long_urls(spark):
    from petrel.llm.warc import READ_BYTES, member, record, round_trip, salvage

    urls = ["http://a/" + " " * 30_000, "http://a/" + "x" * 70_000, "http://a/" + "é" * READ_BYTES, "http://a/"]
    df = spark.createDataFrame([(k, u, "same") for k, u in enumerate(urls)], "page_id long, url string, html string")
    assert rows_of(round_trip(df), "page_id", "record_type", "refers_to") == [(0, "response", None), (1, "revisit", 0), (2, "revisit", 0), (3, "revisit", 0)]
    recs = [record(k, u, b"payload", k) for k, u in enumerate(urls)]
    for data in (b"".join(recs), b"".join(map(member, recs))):
        got = list(salvage(io.BytesIO(data)))
        assert [(what, c[0]["x-page-id"], len(c[0]["warc-target-uri"])) for what, _, c in got] == [("record", "0", 90_009), ("record", "1", 70_009), ("record", "2", READ_BYTES + 9), ("record", "3", 9)]
    torn = recs[2][:-40] + b"?"
    assert [(what, c if what == "gap" else c[0]["x-page-id"]) for what, _, c in salvage(io.BytesIO(torn + recs[0]))] == [("gap", len(torn)), ("record", "0")]


def test_warc_salvage():
    from petrel.llm.warc import member, record, salvage

    recs = [record(k, f"http://x/{k}", b"hello" * k, k) for k in range(6)]
    seen = lambda data: [(what, c if what == "gap" else c[0]["x-page-id"]) for what, _, c in salvage(io.BytesIO(data))]
    whole = [("record", str(k)) for k in range(6)]
    assert seen(b"".join(map(member, recs))) == whole and seen(b"".join(recs)) == whole
    torn = member(recs[2])[:-9]
    assert seen(member(recs[0]) + b"junk" * 9 + torn + member(recs[3]) + b"xx") == [("record", "0"), ("gap", 36 + len(torn)), ("record", "3"), ("gap", 2)]
    changed = recs[1].replace(b"hello", b"jello")
    assert seen(recs[0] + changed + b"?" + recs[2] + recs[4][:-30]) == [("record", "0"), ("gap", len(changed) + 1), ("record", "2"), ("gap", len(recs[4]) - 30)]
    assert seen(b"") == [] and seen(b"WARC") == [("gap", 4)]


def test_warc_reads_no_further_than_it_must():
    from petrel.llm.warc import READ_BYTES, Damaged, Window, _from_member, member, record, salvage

    class Stream(io.BytesIO):
        taken = 0

        def read(self, n):
            got = super().read(n)
            self.taken += len(got)
            return got

    good = record(1, "http://x/", b"hello", 1)
    wrong = good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9" + b"9" * 9)
    data = wrong + good + b"".join(record(k, "u", b"x" * 50_000, k) for k in range(100))
    s = Stream(data)
    first = next(iter(salvage(s, len(data))))
    assert first[0] == "gap" and first[2] == len(wrong) and s.taken <= 2 * READ_BYTES
    bomb = member(good + b"\0" * (300 << 20))
    with pytest.raises(Damaged):
        _from_member(Window(io.BytesIO(bomb)))
    assert [(w, x if w == "gap" else x[0]["x-page-id"]) for w, _, x in salvage(io.BytesIO(bomb + member(good)))] == [("gap", len(bomb)), ("record", "1")]


def test_warc_reads_damaged_archives(spark, tmp_path):
    from petrel.llm.warc import member, read, record

    recs = [record(k, f"http://x/{k}", b"hello" * k, k if k != 3 else 1) for k in range(5)]
    torn = member(recs[2])[:-9]
    (tmp_path / "a.warc.gz").write_bytes(b"".join([member(recs[0]), member(recs[1]), torn, member(recs[3]), b"??"]))
    (tmp_path / "b.warc").write_bytes(recs[4] + b"junk")
    (tmp_path / "c.warc").write_bytes(b"")
    names = spark.createDataFrame([("a.warc.gz",), ("b.warc",), ("c.warc",)], "archive string")
    got = read(spark, f"file://{tmp_path}", names, with_payload=True).collect()
    found = {r.page_id: (r.archive, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in got if r.gap_bytes is None}
    assert found == {
        0: ("a.warc.gz", "response", None, 0, b""), 1: ("a.warc.gz", "response", None, 5, b"hello"), 3: ("a.warc.gz", "revisit", 1, 15, None),
        4: ("b.warc", "response", None, 20, b"hello" * 4),
    }
    gaps = sorted((r.archive, r.gap_bytes) for r in got if r.gap_bytes is not None)
    assert gaps == [("a.warc.gz", 2), ("a.warc.gz", len(torn)), ("b.warc", 4)]


def test_line_dedup(spark):
    from petrel.llm.line_dedup import dedup

    pages = [(k, f"http://WWW.Site.com:80/{k}", f"<nav>menu</nav><p>unique {k}</p>\n menu \nfoot") for k in range(6)]
    pages += [(10, "https://other.org/", "menu\nfoot"), (11, None, "menu"), (12, "https://other.org/2", None), (0, "http://site.com/0", "menu<br>x")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = sorted((tuple(r) for r in dedup(df).collect()), key=str)
    assert (0, "site.com", 4, 3, "unique 0") in got and (0, "site.com", 2, 1, "x") in got
    assert (10, "other.org", 2, 0, "menu\nfoot") in got and (11, "", 1, 0, "menu") in got and (12, "other.org", 0, 0, "") in got
    assert dedup(df.limit(0)).count() == 0


def test_codewords():
    from petrel.llm.langid import codewords

    for n in (2, 3, 4, 6, 9):
        c = codewords(n)
        assert len({tuple(r) for r in c}) == n and (abs(c.sum(0)) < n).all()
    c = codewords(4)
    assert min((c[i] != c[j]).sum() for i in range(4) for j in range(i)) == 4


def test_language(documents):
    from petrel.llm.langid import predict

    r = random.Random(1)
    words = {"aa": ["the", "and", "of", "with", "house"], "bb": ["der", "und", "von", "mit", "haus"], "cc": ["le", "et", "de", "avec", "maison"]}
    rows = [(k, " ".join(r.choice(words[g]) for _ in range(20)), g, g) for k, g in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa", "x"), (1001, "123 !", "bb", "x"), (1002, "", None, None), (None, "the house of the house", "aa", "x")]
    got = {x.doc_id: x for x in predict(documents(rows, clash=("score", "held_out"))).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == g for k, _, g, _ in rows[:180]) and any(got[k].held_out for k in range(180))
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1001].score == 0
    assert got[None].lang_pred == "aa" and all(0 <= x.score <= 1 for x in got.values())
    learnt, unseen = (next(k for k in range(100) if (zlib.crc32(str(k).encode()) % 3 == 1) is held) for held in (False, True))
    few = {x.doc_id: (x.lang_pred, x.score) for x in predict(documents([(learnt, "the", "aa", "x"), (unseen, "der", "aa", "x"), (200, "?", "aa", "x")])).collect()}
    assert few == {learnt: ("aa", 1.0), unseen: ("aa", 1.0), 200: ("und", 0.0)}
    assert {x.lang_pred for x in predict(documents([(2, "the", None, "x")])).collect()} == {"und"}
    assert predict(documents([])).count() == 0


def test_decoding_equals_the_sum_over_bits():
    from petrel.llm import langid

    r = np.random.default_rng(3)
    for classes in (2, 4, 9):
        code = langid.codewords(classes)
        bits = code.shape[1]
        m = langid.Model([str(k) for k in range(classes)], code, r.normal(size=(langid.BUCKETS + 1, bits)).astype(np.float32), r.random((classes, bits)))
        x = r.random((3, langid.BUCKETS)).astype(np.float32) / 50
        got = m.distances(x)
        for row, d in zip(x, got, strict=True):
            margins = [sum(float(a) * float(w) for a, w in zip(row, m.weights[:-1, k], strict=True)) + float(m.weights[-1, k]) for k in range(bits)]
            for c in range(classes):
                assert d[c] == pytest.approx(sum(m.trust[c, k] * np.exp(-margins[k] * code[c, k]) for k in range(bits)) / bits, rel=1e-3)


def test_every_language_is_learned(documents):
    from petrel.llm import langid

    rows = [(k, " ".join(f"{chr(97 + k % 40 // 2)}{chr(97 + k % 40)}q" if k % 40 < 20 else f"x{chr(97 + k % 20)}z" for _ in range(8)), f"l{k % 40:02}", "s") for k in range(1200)]
    assert langid.learn(documents(rows)).languages == sorted({g for _, _, g, _ in rows})


def test_identified_drops_what_no_codeword_is_near_to(documents):
    from petrel.llm import langid

    model = langid.Model(["a", "b"], langid.codewords(2), np.zeros((langid.BUCKETS + 1, 1), np.float32), np.ones((2, 1)))
    df = documents([(1, "words", "a", "s"), (2, None, "a", "s"), (3, "12", None, "s")])
    assert langid.identified(df, model).count() == 0  # the classifier says nothing: a tie, far from both
    model.weights[-1] = 3
    assert [r.doc_id for r in langid.identified(df, model).collect()] == [1]


def test_machine_equals_the_sum_over_pairs():
    from petrel.llm.quality import Machine

    r = np.random.default_rng(0)
    m, x = Machine(0.3, r.normal(size=6), r.normal(size=(6, 3))), r.normal(size=(4, 6))
    for row, got in zip(x, m.raw(x), strict=True):
        pairs = sum(m.factors[i] @ m.factors[j] * row[i] * row[j] for i in range(6) for j in range(i + 1, 6))
        assert got == pytest.approx(0.3 + m.linear @ row + pairs)


def test_quality(spark, documents):
    from petrel.llm.quality import predict

    r = random.Random(4)
    good = lambda: " ".join(r.choice(["calm", "river", "stone", "bird", "tree"]) for _ in range(40)) + "."
    bad = lambda: " ".join(r.choice(["win$$$", "CASH!!!", "click###", "now***"]) for _ in range(40))
    rows = [(k, good() if k % 3 else bad(), "en", "s") for k in range(240)] + [(900, None, None, None), (901, "", "en", "s")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(200)] + [(5, 7, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in predict(documents(rows, clash=("quality", "score")), labels).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got.values())
    unseen = [k for k in range(240) if got[k].held_out or k >= 200]
    assert sum(got[k].predicted == int(k % 3 > 0) for k in unseen) >= 0.97 * len(unseen)
    none = predict(documents(rows), labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}
    assert predict(documents([]), labels).count() == 0


def test_max_score(spark):
    from petrel.llm.maxscore import every, top_k

    r = np.random.default_rng(1)
    data = [(int(k), [float(x) for x in r.normal(0, 0.3, 8)]) for k in range(300)]
    data[7] = (7, data[8][1])
    data += [(20, data[20][1]), (400, None), (401, [0.1, None]), (402, [float("nan")]), (403, [float("inf")]), (404, []), (405, [0.5, 0.5]), (None, [0.1] * 8), (40, [9.0])]
    df = spark.createDataFrame([(*d, "x") for d in data], "vec_id long, embedding array<float>, score string")
    kept = {(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    want = []
    for q in sorted({i for i, _ in kept if i % 20 == 0}):
        own = min(v for i, v in kept if i == q)
        best = sorted((-dot(own, v), i, v) for i, v in kept if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i, _) in enumerate(best)]
    for shard, block in ((1 << 14, 1 << 11), (40, 4)):
        assert rows_of(top_k(df, every(), shard=shard, block=block), "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert top_k(df.limit(0), every()).count() == 0


def test_max_score_of_large_components():
    import pyarrow as pa

    from petrel.llm.maxscore import _matrix, search

    r = random.Random(6)
    for top in (1 << 20, 1 << 28):  # the sums of the second lie beyond 2 ** 53
        data = [[r.randrange(-top, top) for _ in range(16)] for _ in range(60)]
        data += [[x + (k == 3) for k, x in enumerate(v)] for v in data[:30]] + [data[5]]  # scores that differ by one weight
        m, ids = _matrix(pa.array(data, pa.list_(pa.int64())), 16), np.arange(len(data))
        queries = [*data[:9], [1 << 28] * 15 + [1]]
        found = search(np.arange(len(queries)) + 1000, _matrix(pa.array(queries, pa.list_(pa.int64())), 16), ids, m, 20)
        for q, (at, scores) in zip(queries, found, strict=True):
            best = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), k) for k, v in enumerate(data))[:20]
            assert [(-int(s), int(k)) for k, s in zip(at, scores, strict=True)] == best


def test_mix(corpus, documents):
    from petrel.llm.mixing import mix, repeated, word_count

    rows, df = corpus
    out = mix(df).collect()
    assert len(out) == len(rows)
    total = sum(len(WORDS.findall(t or "")) for _, t, *_ in rows)
    by = defaultdict(list)
    for x in out:
        by[x.source].append(x)
        assert x.taken % max(1, x.size) == 0 and x.taken <= 3 * x.size
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert sum(x.size for x in v) == v[0].source_size
        assert abs(sum(x.taken for x in v) - v[0].target) <= max(x.size for x in v) and v[0].target <= 3 * v[0].source_size
    assert sorted(map(str, out)) == sorted(map(str, mix(df).collect()))
    assert mix(documents([])).count() == 0
    assert {x.taken for x in mix(documents([(1, None, "en", "a"), (2, " ", "en", None)])).collect()} == {0}
    assert repeated(documents(rows[:60])).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    odd = documents([(k, t, "en", "a") for k, t in enumerate(["a b", " a b ", "\x0b\x1cx\x0cy", None, ""])])
    assert [r.n for r in odd.orderBy("doc_id").select(word_count(F.col("text")).alias("n")).collect()] == [2, 1, 2, 0, 0]


def test_components(spark):
    from petrel.llm.components import components

    r = random.Random(5)
    links = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for start in got:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_encoder_takes_slices_and_odd_texts():
    import pyarrow as pa

    from petrel.llm import token_files
    from petrel.llm.queries import tokenizer_path

    r = random.Random(5)
    parts = ["a", "B", "the", " ", " ", "  ", "\n", "\n\n", "\t", " ", ".", ",", "'s", "é", "漢", "😀", "<|endoftext|>", "12", "!"]
    texts = [None, "", "\n", " ", "\na", " a", "a ", "a\n", "a.\n", None] + ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(1000)]
    encoder, column = token_files.Encoder(tokenizer_path()), pa.array(texts, pa.string())
    got = [x for at in range(0, len(texts), 97) for x in encoder.all(column.slice(at, 97), 0)]
    want = [np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert got == want and encoder.all(column.slice(0, 0), 0) == []


def test_encoder_of_a_tokenizer_that_does_not_keep_white_space():
    import public_tokenizers as P

    from petrel.llm.token_files import Encoder

    r = random.Random(7)
    texts = [None, "", " ", "a b", "word.\nNext", "<|startoftext|> it's"] + ["".join(r.choices(["a", "Be", " ", "\n", ".", "é", "12", "<|endoftext|>"], k=r.randint(0, 20))) for _ in range(300)]
    e = Encoder(P.path("word_bpe_49k.json"))
    assert not e.by_word and Encoder(P.path("byte_bpe_50k.json")).by_word
    assert e.all(texts, 0) == [np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_token_files_of_one_id(spark, documents, tmp_path, doc_id):
    from petrel.llm import token_files
    from petrel.llm.queries import tokenizer_path

    r = random.Random(3)
    texts = [None, "", "same start " * 9, "same start " * 9 + "b", "same start " * 9 + "a", "é", "😀", "\uffff"] + [" ".join(r.choices(["one", "two", "six"], k=40)) for _ in range(200)]
    folder = f"file://{tmp_path}"
    files = token_files.write(documents([(doc_id, t, None, None) for t in texts]), folder, tokenizer_path(), file_bytes=4000)
    assert files.count() > 3 and files.selectExpr("max(docs)").first()[0] < len(texts) // 2
    got = sorted(token_files.read(spark, folder, files, with_ids=True).collect(), key=lambda x: x.start)
    tokenizer = token_files.Encoder(tokenizer_path()).tokenizer
    # in the order of the texts' bytes, as the range of a text is found by its beginning
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in sorted(texts, key=lambda t: (t is not None, (t or "").encode()))]
    assert [x.ids for x in got] == want and {x.doc_id for x in got} == {doc_id}
    assert [x.start for x in got] == np.cumsum([0, *map(len, want[:-1])]).tolist()


def test_encoder_makes_no_objects_of_words(monkeypatch):
    import cProfile
    import pstats

    from petrel.llm import token_files
    from petrel.llm.queries import tokenizer_path

    monkeypatch.setattr(token_files, "REMEMBERED", 3000)
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdeéñ", k=r.randint(2, 9))) + r.choice(["", "", ",", ".", "!?"])
    texts = ["".join(word() + r.choice([" ", " ", "\n"]) for _ in range(100)) + "end" for _ in range(400)]
    encoder, profile, got = token_files.Encoder(tokenizer_path()), cProfile.Profile(), []
    for at in range(0, len(texts), 50):
        profile.enable()
        got += encoder.all(texts[at : at + 50], 0)
        profile.disable()
        assert len(encoder.known) < 3000 + 2 * 5100
    assert got == [np.array([*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert pstats.Stats(profile).total_calls < 10_000  # of 40,400 words, most of them different


def test_encoder_remembers_words_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    from petrel.llm import token_files
    from petrel.llm.queries import tokenizer_path

    r = random.Random(13)
    texts = [" ".join("".join(r.choices("abcdefgh", k=8)) for _ in range(1000)) for _ in range(100)]
    encoder = token_files.Encoder(tokenizer_path())
    encoder.all(texts[:1], 0)
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        encoder.all(texts, 0)
        held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    finally:
        tracemalloc.stop()
    assert held < 100 * 99_718  # bytes, of as many different words; 51 a word as measured, 138 with an object for each
