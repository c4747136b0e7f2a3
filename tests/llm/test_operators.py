"""Each operator against brute force or the library it must equal, and its defined results for odd input."""

import base64
import collections
import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewright.llm import ann, bpe, html, minhash, mixing, pii, quality, secrets, tokencount, warc

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ODD = ["", "   \n", "one", "aé́ ΣΑΣ it's 'st ''s 12½ <|endoftext|>x", LONG, "rep rep rep " * 40]
SCHEMA = "doc_id long, text string, source string, lang string, `_s` string, id string, n_chars long"


def frame(spark, texts, schema=SCHEMA):
    """Documents with repeated rows, a null text, a null source, a null id and columns whose names operators use themselves."""
    rows = [(i, t, "s%d" % (i % 3), "en", "clash", "clash", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], (900, None, None, None, None, None, None), (None, "no id here", "s1", None, None, None, None)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def prose():
    g = random.Random(3)
    words = ["".join(g.choice("abcdefghij") for _ in range(g.randint(2, 8))) for _ in range(3000)]
    return [" ".join(g.choice(words) for _ in range(g.randint(60, 200))) for _ in range(40)]


def test_bpe_equals_the_library(spark, prose):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = frame(spark, ODD + prose)
    got = bpe.encode_decode(spark, docs, path, lexicon_words=500, keep_ids=True).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(spark, docs.limit(0), path).count() == 0


def test_every_character_is_encoded_as_in_the_library():
    """Each code point between letters and beside marks that may compose with it; Python's Unicode may be older than the library's."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), bpe.Encoder(bpe.vocabulary_of(path), None, bpe.char_table())
    texts = ["".join(f"a{chr(c)}1 {chr(c)}\u0307{chr(c)}" for c in range(b, b + 512) if not 0xD800 <= c < 0xE000) for b in range(0, 0x110000, 512)]
    texts = [x for x in texts if x]
    ids, bounds = e.encode(texts)
    for k, x in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, hex(ord(x[1]))


def test_lexicon_is_a_minimal_exact_index(tmp_path):
    v = bpe.vocabulary_of(public_tokenizers.path("word_bpe_49k.json"))
    words = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops"]
    (tmp_path / "lexicon").write_bytes(bpe.Lexicon(words, v).packed())
    x = bpe.Lexicon.mapped(str(tmp_path / "lexicon"))
    assert len(x.final) == 7  # the ends "p" and "ps" are shared
    p = bpe.Pieces(["taps stop nope to tops"], v.special, bpe.char_table())
    assert x.find(p).tolist() == [sorted(words).index(w) if w in words else -1 for w in (b"taps", b"stop", b"nope", b"to", b"tops")]


def test_secrets(spark):
    b64 = lambda d: base64.urlsafe_b64encode(d).decode().rstrip("=")
    jwt = ".".join([b64(json.dumps({"alg": "HS256"}).encode()), b64(b'{"sub":"1"}'), b64(b"x" * 32)])
    body = bytes([2, 1, 0]) + bytes([4, 30]) + b"k" * 30
    der = bytes([0x30, len(body)]) + body
    texts = [
        f"see {jwt} now", "see " + base64.b64encode(der).decode(), der.hex() + "00", "password: token: abcdefghijklmnop", "TOKEN = 'abcdefghijkl'", "AKIA" + "A1" * 7, "AKIASHORT",
        "-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(der).decode() + "\n-----END PRIVATE KEY-----", base64.b64encode(b"z" * 60).decode(), "\U0001f600 api_key=0123456789abcdef0",
    ]
    got = {r.doc_id: r for r in secrets.scan(frame(spark, texts)).collect() if r.doc_id is not None}
    assert got[0].spans == f"jwt:4:{4 + len(jwt)}"
    assert got[1].spans.startswith("der:4:") and got[2].n_confirmed == 0
    assert got[3].spans == "" and got[4].n_assign == 1 and got[5].n_access == 1 and got[6].spans == ""
    assert got[7].spans.startswith("pem:0:") and got[8].spans == ""
    assert got[9].spans == "assign:2:27,hex:10:27"  # offsets in code points
    assert got[900].spans == "" and got[900].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_mixing_meets_targets(spark, prose):
    rows = [(i, t, f"s{i % 5}" if i % 7 else None) for i, t in enumerate(prose * 20)] + [(5000, None, "s0"), (5001, "", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    total, w = sum(size.values()), {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / max(1, sum(w[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and level * w[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * size[s] if s in capped else level * w[s] for s in order}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * 200 + 1 for s in order) and sum(taken.values()) <= total
    again = mixing.mix(spark, docs.repartition(7)).collect()
    key = lambda r: (r.id, str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed_documents(spark, docs).count() == sum(r.copies for r in got if r.size > 0)
    assert mixing.mix(spark, docs.limit(0)).count() == 0


def test_quality_counts(spark, prose):
    texts = ODD + prose + ["a b c a b c", "line\nline\n\n \nline two\nline two", "x# y$ %% <|>"] + ["### *** $$$ %%% " * 30 + " ".join(p.split()[:40]) for p in prose[:5]]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(ODD), len(ODD) + 30)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in quality.judged(spark, docs, labels).collect() if r.id is not None}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n, covered = collections.Counter(windows), set()
        for k, x in enumerate(windows):
            if n[x] > 1:
                covered |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert not got[900].kept and all(got[i].kept for i in range(len(ODD), len(ODD) + 40)) and not any(got[len(texts) - 1 - k].kept for k in range(5))
    assert quality.good_documents(spark, docs, labels).columns == docs.columns
    assert quality.judged(spark, docs.limit(0), labels.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "text " * 400 + "</p>"
    rows = [(1, "http://a b/\nc", big), (2, None, big), (3, "http://x", "small"), (4, "http://y", "small"), (5, "u", None), (2, None, big), (None, "n", "é" * 600), (7, "h", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n" + "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    got = sorted(map(tuple, warc.archived(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    n = lambda t: len((t or "").encode())
    want = []
    for i, (p, _, t) in enumerate(rows):
        again = t == big and i != 1 and i != 5
        want.append((p, n(t), sha(t), "revisit" if again else "response", 2 if again else None))
    assert [w for w in sorted(want, key=str) if w[0] != 2] == [g for g in got if g[0] != 2]
    two = [g for g in got if g[0] == 2]
    assert sorted(x[3] for x in two) == ["response", "revisit"]
    assert warc.archived(spark, pages.limit(0)).count() == 0


def test_warc_digests_are_checked(spark, tmp_path):
    """A payload or a block that isn't what its header says is refused."""
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    wrong = warc.warc_record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Payload-Digest", warc.sha1_32(b"other"))], block) + b"\r\n\r\n"
    right = wrong.replace(warc.sha1_32(b"other").encode(), warc.sha1_32(b"hello").encode())
    for k, (data, ok) in enumerate([(right, True), (wrong, False), (right.replace(b"hello", b"hullo"), False)]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "part-0").write_bytes(data)
        got = warc.read_warc(spark, str(tmp_path / str(k)))
        if ok:
            assert [r.payload_digest for r in got.collect()] == [hashlib.sha1(b"hello").hexdigest()]
        else:
            with pytest.raises(Exception, match="match"):
                got.collect()


def test_arc_versions():
    one = warc.arc_head("1", "a.arc") + b"\nhttp://u 1.2.3.4 20200102030405 text/html 5\nhello"
    two = warc.arc_head("2", "b.arc") + b"\nhttp://v 1.2.3.4 20200102030405 text/html 200 - - 0 b.arc 4\nbody\n"
    got = list(warc.arc_records(one + b"\n" + two))
    assert [(f[0], b) for _, f, b in got] == [("http://u", b"hello"), ("http://v", b"body")]
    with pytest.raises(ValueError):
        list(warc.arc_records(one[:-1]))
    with pytest.raises(ValueError):
        list(warc.arc_records(two + b"http://w 1.2.3.4 20200102030405 text/html 4\nbody"))


def test_ann_recall_and_odd_vectors(spark):
    g = np.random.default_rng(5)
    x = g.standard_normal((3000, 16)).astype(np.float32)
    x[200:260] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None), (10_100, [0.0] * 16), (10_200, [float("nan")] * 16), (10_300, [1.0, None] + [0.5] * 14), (10_400, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in ann.search(spark, df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    y = x.astype(np.float64)
    for q in got:
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        hit += len(set(best) & {i for i, _ in got[q]})
        assert all(abs(s - d[i]) < 1e-9 for i, s in got[q]) and len(got[q]) == 10
    assert hit >= 0.9 * 10 * len(got)
    assert [i for i, _ in got[100]] == list(range(200, 210))
    assert ann.search(spark, df.limit(0)).count() == 0
    assert ann.search(spark, df.where("vec_id < 4")).where("query_id = 0").count() == 3


def test_pii_surrogates(spark):
    texts = [
        "Write to Ann.Lee7@corp.example.com or +1 (425) 555-0134, from 10.20.30.40.",
        "again ANN.LEE7@corp.example.com and +1 425 555 0134 and 4111 1111 1111 1111",
        "Mrs. Ann Weil met Mr. Weil and Господин Иван Петров, 078-05-1120, DE89370400440532013000",
        "clean text, version 2.0. in 2024 and 3.14", "", LONG,
    ]
    docs = frame(spark, texts)
    out = pii.pseudonymised(spark, docs, "k").select("row.doc_id", "row.text", "safe", "found").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == docs.count() and got[900].safe is None and got[4].safe == "" and got[3].safe == texts[3] and got[5].safe == LONG
    for r in out:
        for x in r.found:
            assert x not in r.safe
    mail = re.search(r"\S+@\S+", got[0].safe)[0]
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@h[0-9a-f]{10}\.example\.net", mail) and mail.lower() == re.search(r"\S+@\S+", got[1].safe)[0].lower()
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[0].safe)[0]) == digits(re.search(r"\+1 \d{3} \d{3} \d{4}", got[1].safe)[0])
    card = digits(re.search(r"4\d{3} \d{4} \d{4} \d{4}", got[1].safe)[0])
    assert sum((2 * int(c) - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(card))) % 10 == 0
    names = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) and Господин ([Ѐ-ӿ]+) ([Ѐ-ӿ]+), 9\d\d-\d\d-\d{4}, DE\d{20}$", got[2].safe)
    assert names and names[1] in pii.GIVEN["f", "latin"] and names[2] == names[3] and names[4] in pii.GIVEN["m", "cyrillic"]
    assert pii.safe_documents(spark, docs, "k").columns == docs.columns and pii.safe_documents(spark, docs.limit(0), "k").count() == 0


def test_pii_collisions_are_resolved(spark):
    rows = [(i, f"Mr. A{chr(97 + i % 26)}{chr(97 + i // 26)} Stone was here") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # The 16 given names can't tell 200 people of one surname apart; all still end up distinct.
    safe = [r.safe for r in pii.pseudonymised(spark, docs, "k").collect()]
    assert len(set(safe)) == 200 and len({x.split()[2] for x in safe}) == 1
    mails = spark.createDataFrame([(i, f"{c}@one.example.org and {c}{c}@one.example.org") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")], "doc_id long, text string")
    found = [m for r in pii.pseudonymised(spark, mails, "k").collect() for m in re.findall(r"\S+@\S+", r.safe)]
    assert len(set(found)) == 52


def test_tokencount_equals_a_recount(spark, prose):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    docs = frame(spark, ODD + prose).withColumn("edits", tokencount.sample_edits(F.col("doc_id"), F.col("text")))
    rows = {r.doc_id: r for r in docs.collect()}
    for r in tokencount.counted(spark, docs, path).collect():
        text = rows[r.doc_id].text or ""
        assert r.n_tokens == len(t.encode(text, add_special_tokens=False).ids)
        for e in rows[r.doc_id].edits:
            text = text[: e.start] + e.replacement + text[e.start + e.length :]
        assert r.n_tokens_after == len(t.encode(text, add_special_tokens=False).ids) and r.n_chars_after == len(text)
    edits = spark.createDataFrame([(1, 1, 0, 3, "xyz"), (1, 2, 1, 1, None)], "doc_id long, seq int, start long, length long, replacement string")
    assert tokencount.counted(spark, tokencount.with_edits(docs.drop("edits"), edits), path).count() == docs.count()
    assert tokencount.counted(spark, docs.limit(0), path).count() == 0


def test_kept_trees_are_edited_again(spark, prose):
    """Trees that were kept take further edits; what is encoded is what the edits touch, and the leaves equal those of the new text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(list(enumerate([*prose, LONG, "", None])), "doc_id long, text string").selectExpr("*", "'clash' AS lengths", "1 AS n_tokens")
    trees = tokencount.trees(docs, path).cache()
    texts = {r.doc_id: r.text for r in trees.collect()}
    for turn in range(3):
        trees = trees.select("doc_id", "text", "lengths", "counts").withColumn("edits", tokencount.sample_edits(F.col("doc_id") + 1000 * turn, F.col("text"), 4))
        for r in trees.collect():
            for e in r.edits:
                texts[r.doc_id] = texts[r.doc_id][: e.start] + e.replacement + texts[r.doc_id][e.start + e.length :]
        trees = tokencount.edited(trees, path).cache()
        again = {r.doc_id: r for r in tokencount.trees(trees.select("doc_id", "text"), path).collect()}
        for r in trees.collect():
            assert (r.text, r.lengths, r.counts, r.n_tokens) == (texts[r.doc_id], again[r.doc_id].lengths, again[r.doc_id].counts, again[r.doc_id].n_tokens)
            assert r.n_encoded <= 4 * 60 or r.n_pieces < 200


def test_counts_are_made_without_the_leaves(spark, prose):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame(list(enumerate([*prose, "", None])), "doc_id long, text string")
    trees = tokencount.trees(docs, path).withColumn("edits", tokencount.sample_edits(F.col("doc_id"), F.col("text")))
    whole, numbers = tokencount.edited(trees, path), tokencount.edited(trees, path, leaves=False)
    assert numbers.columns == [c for c in whole.columns if c not in ("text", "lengths", "counts")]
    assert sorted(numbers.collect()) == sorted(whole.select(numbers.columns).collect())


def test_segment_tree_edits():
    v = bpe.vocabulary_of(public_tokenizers.path("byte_bpe_50k.json"))
    c = tokencount.Counter(v)
    g = random.Random(1)
    bits = ["a", " ", "\n", "'", "r", "e", "ll", "1", "!", "é", "  \n ", " word", "'re"]
    for _ in range(300):
        text = "".join(g.choice(bits) for _ in range(g.randint(0, 300)))
        p = tokencount.PATTERN.findall(text)
        c.learn(p)
        tree = tokencount.Tree(text, np.array([len(x) for x in p], np.int32), np.array([c.known[x] for x in p], np.int32))
        for _ in range(4):
            a, n, new = g.randint(0, len(text) + 2), g.choice([0, 1, 5, 400]), "".join(g.choice(bits) for _ in range(g.choice([0, 1, 2, 200])))
            e = tokencount.Edit(tree, a, n, new)
            c.learn(e.new)
            e.apply(c.known)
            a = min(a, len(text))
            text = text[:a] + new + text[a + n :]
            want = tokencount.PATTERN.findall(text)
            assert tree.leaves()[0] == text and [x for b in tree.blocks for x in b.pieces] == want and tree.total == sum(c.known[x] if x in c.known else c.learn([x]) or c.known[x] for x in want)


def near_classes(texts):
    """Brute force: classes under weighted Jaccard similarity with even document frequencies."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    weight = lambda n: 1 + np.log(n)
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or ""):
                parent[root(i)] = root(j)
            elif sets[i] and sets[j]:
                both = sum(weight(min(sets[i][x], sets[j][x])) for x in sets[i].keys() & sets[j].keys())
                if both >= 0.8 * (sum(map(weight, sets[i].values())) + sum(map(weight, sets[j].values())) - both):
                    parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("large", [64, 2])
def test_minhash_classes(spark, prose, large, monkeypatch):
    g = random.Random(9)
    texts = ODD + prose
    for base in prose[:6]:
        for k in (1, 2, 3, 6, 12):
            w = base.split()
            for _ in range(k):
                w[g.randrange(len(w))] = "changed%d" % g.randrange(10**6)
            texts = [*texts, " ".join(w)]
    texts += [prose[7], prose[7], "", None]
    monkeypatch.setattr(minhash, "LARGE", large)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("th", F.lit("clash"))
    got = {r.id: r.class_id for r in minhash.classes(spark, docs).collect()}
    want = near_classes(texts)
    least = {}
    for i, c in enumerate(want):
        least.setdefault(c, i)
    wrong = [i for i in range(len(texts)) if got[i] != least[want[i]]]
    assert len(wrong) <= 1, wrong  # a pair at the very threshold may fall on either side
    kept = minhash.keep_one(spark, docs.union(docs.limit(1)))
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))
    assert minhash.classes(spark, docs.limit(0)).count() == 0


def test_html_main_text(spark):
    p = "".join(f"<p>Paragraph {i} has enough text in it to count as a line of the article &amp; more.</p>" for i in range(4))
    page = f"<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class='ad'>Buy this now, it is cheap and it is here, one time only for all of you.</div><div>{p}<p>Short <b>bo</b>ld.</p></div><div id=comments><p>A reader thinks that this is far too long a comment to be left out.</p></div><form>name and address and much other text that a form may hold in it</form><script>var t='</p>';</script><footer>&copy; me</footer></body>"
    want = " ".join(f"Paragraph {i} has enough text in it to count as a line of the article & more." for i in range(4)) + " Short bold."
    assert html.main_text(page) == want
    assert html.main_text("<nav>menu</nav><article><h1>T</h1><p>x<br>y</article><footer>f") == "T x y"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("<article>a < b &am") == "a < b &am"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "<p>" + "long text " * 50_000)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)


def test_mixing_of_odd_rows(spark, prose):
    """Repeated rows are rows of their own, equal and missing ids don't meet in one block, other columns don't matter."""
    rows = [(1, prose[0], "a"), (1, prose[0], "a"), (1, prose[1], "a"), (None, prose[2], "a"), (None, prose[3], None), (7, "", "b"), (8, None, "b"), *[(None, prose[i % 40] + f" {i}", "b") for i in range(300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS size", "'y' AS taken", "1 AS block", "2 AS `_s`", "3 AS `row`", "4 AS n", "5 AS key")
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    mixed = mixing.mixed_documents(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
