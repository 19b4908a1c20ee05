"""Every stage of the pipeline against brute force, with clashing columns, nulls, repeats and very long texts."""

import random
import re

import pytest

import corpus_pipeline
from stratiform.llm import decontam, lines, packing, registry, simhash, tokens, toxicity
from stratiform.llm.common import Store

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu the of and".split()
CLASH = ["key", "t_id", "t_key", "k_id", "k_key", "bad_id", "bad_key", "lost", "gone", "fp", "root", "n", "words", "score", "predicted", "hits", "doc_key", "line", "l.lost"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(21)
    d = str(tmp_path_factory.mktemp("stages"))
    make = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    bench = [(1, make(30)), (2, make(13)), (3, None), (4, "")]
    texts = [make(rng.randint(15, 60)) + "\n" + make(rng.randint(3, 20)) for _ in range(60)]
    texts += [make(20) + f" idiot scum {make(3)} moron you are a worthless loser! trash" for _ in range(40)]
    texts += [texts[5], texts[6], texts[7] + "\n" + make(12), texts[8].replace("alpha", "alpho", 1), None, "", "\n\n", bench[0][1], make(10) + " " + bench[1][1] + " " + make(10), make(600) + " " + " ".join(bench[0][1].split()[:13])]
    rows = [(i, t, "en", "s", len(t or ""), *CLASH) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s", 1, *CLASH), (None, texts[9], "en", "s", 1, *CLASH), (None, make(30), "en", "s", 1, *CLASH)]
    names = ", ".join(f"`{c}` string" for c in CLASH)
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names}").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 100)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def kept(df):
    assert df.columns[5:] == CLASH
    out = df.collect()
    assert all(list(r)[5:] == CLASH for r in out)
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in out))


def plain(rows):
    return sorted((i is None, i or 0, t or "", t is None) for i, t in rows)


def distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def without_lines(rows):
    rule = lambda n: max((e for least, e in lines.BY_LENGTH if least <= n), default=0)
    place = lambda i, no: (i is None, i or 0, no)
    every = [(place(i, no), x) for i, t in rows for no, x in enumerate((t or "").split("\n"))]
    first = {}
    for p, x in every:
        first[x] = min(first.get(x, p), p)
    known = sorted(first)
    for a in range(len(known)):
        for b in range(a + 1, len(known)):
            x, y = known[a], known[b]
            most = rule(min(len(x), len(y)))
            if most and distance(x, y, most) <= most:
                low = min(first[x], first[y])
                first.setdefault((x, "linked"), low), first.setdefault((y, "linked"), low)
                first[x, "linked"], first[y, "linked"] = min(first[x, "linked"], first[y]), min(first[y, "linked"], first[x])
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        stay = [x for no, x in enumerate(own) if x == "" or not (first[x] < place(i, no) or first.get((x, "linked"), place(i, no)) < place(i, no))]
        if len(stay) == len(own):
            out.append((i, t))
        elif any(stay):
            out.append((i, "\n".join(stay)))
    return out


def one_of_each(rows):
    fps = [int(x) for x in simhash.fingerprints([t for _, t in rows])]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                ga, gb = group[a], group[b]
                group = [gb if g == ga else g for g in group]
    return [min(((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g)) for g in sorted(set(group))]


def clean(rows, items):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    windows = set()
    for t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    out = []
    for i, t in rows:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t))
    return out


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    store = Store(spark)

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), Store(spark))
    bad = {t for (_, t), s in zip(rows(docs), model.scores([t for _, t in rows(docs)]), strict=True) if s >= 0.7}
    now = store.put(stages["toxicity"](spark, docs, sf), "a")
    assert kept(now) == plain([x for x in rows(docs) if x[1] not in bad])
    ids = {r.doc_id for r in now.collect()}
    assert sum(i in ids for i in range(60, 100)) <= 2 and sum(i in ids for i in range(60)) >= 58

    before, now = rows(now), store.put(stages["line_dedup"](spark, now, sf), "b")
    assert kept(now) == plain(without_lines(before)) and len(rows(now)) < len(before)

    before, now = rows(now), store.put(stages["simhash_dedup"](spark, now, sf), "c")
    assert sorted((r[0] is None, r[0] or 0) for r in rows(now)) == sorted(one_of_each(before))

    before, now = rows(now), store.put(stages["decontamination"](spark, now, sf), "d")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert kept(now) == plain(clean(before, items)) and len(rows(now)) < len(before)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    out = stages["packing"](spark, now, sf).toPandas()
    want = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows(now))
    assert out.length.sum() == want
    assert corpus_pipeline.run(spark, sf).count() == len(out)


def test_duplicates_and_contamination_are_caught(spark):
    """Copies go and benchmark passages go, each stage on its own input."""
    rng = random.Random(5)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(6)]
    docs = [(i, t) for i, t in enumerate(base + base[:3] + [base[5].upper()])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df, Store(spark)).collect()) == [0, 1, 2, 3, 4, 5]
    items = spark.createDataFrame([(7, " ".join(base[0].split()[5:30]))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.drop_contaminated(df, items, Store(spark)).collect()) == [1, 2, 3, 4, 5, 7, 8, 9]


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_packing", "op3_lines", "op4_simhash", "op5_substrings", "op6_tokens", "op7_pii", "op10_decontam"])
def test_very_long_texts(spark, tmp_path, name):
    """A text of 100,000 words and one of 300,000 letters without a space."""
    text = "lorem ipsum dolor 12 sit, a@b.cd amet. " * 15_000
    rows_ = [(1, text), (2, "x" * 300_000), (3, "x" * 300_000 + "y"), (4, "short")]
    spark.createDataFrame(rows_, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "ipsum dolor 12 sit")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    assert set(got.doc_id) == {1, 2, 3, 4}
    if name == "op10_decontam":
        assert got.set_index("doc_id").n_hit[1] == 60_000
    if name == "op5_substrings":
        assert got.set_index("doc_id").n_removed[3] == 300_000 and got.set_index("doc_id").n_removed[1] == 0
    if name == "op7_pii":
        assert got.set_index("doc_id").n_email[1] == 15_000


def test_tokens_agree_with_brute_force(spark, sf):
    """Greedy longest match of the whole vocabulary, word by word; a character that begins no piece counts its bytes."""
    pieces = set(tokens.load_vocabulary(tokens.vocabulary_path()))
    longest = max(map(len, pieces))

    def count(word):
        at, n = 0, 0
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
            n += 1 if size else len(word[at].encode())
            at += size or 1
        return n

    extra = ["naïve façade 東京 \U0001f600x", "a" * 300, "internationalization's <s> </s> \x00\x01", None]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + extra
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.count_tokens(df, tokens.vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        words = [w for w in re.split(r"[ \t-\r]+", t or "") if w]
        assert got[i] == (len(words), sum(count(tokens.MARK + w) for w in words)), t
