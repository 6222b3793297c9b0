"""Operators on documents: against brute force, and on odd rows."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from tests.llm.conftest import SCHEMA, prose, rows_of
from pyspark.sql import functions as F

from cohortlens.llm import archives, invertible, langid, linededup, minhash, mixing, ngram_lm, pii, semantic

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def test_language(spark, odd, empty):
    def text(kind, k):
        ends = {"aa": "ola ura ena", "bb": "schk tzung pft", "cc": "éau êtr çon"}[kind].split()
        return " ".join(ends[(k * j + j // 3) % 3] + ends[j % 3] for j in range(40))

    docs = spark.createDataFrame(rows_of([(i, text(k, i), k, "s") for i in range(60) for k in [("aa", "bb", "cc")[i % 3]]]), SCHEMA)
    f = langid.learn(docs)
    assert f.langs == ("aa", "bb", "cc")
    got = {r.doc_id: r for r in langid.identify(docs, f).collect()}
    assert all(got[i].lang_pred == ("aa", "bb", "cc")[i % 3] and 0 < got[i].score <= 1 for i in got)
    out = langid.identify(odd, f, ("doc_id", "n", "lang")).collect()
    assert len(out) == odd.count() and out[0].n == 1
    by = {r.doc_id: r for r in out}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (3, 4, 5, 7)) and by[6].lang_pred != "und"
    assert langid.identify(empty, f).count() == 0
    nothing = langid.learn(empty)
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


@pytest.mark.parametrize("slots, error", [(1 << 18, 1e-3), (1 << 12, 0.06)])
def test_language_by_force(spark, slots, error):
    """Sets of n-grams instead of a filter: the same languages and, where the filter is so
    small that it errs often, after the correction nearly the same scores."""
    import random

    import regex

    def grams(text):
        b = regex.sub(r"[^\p{L}\p{M}]+", " ", f" {(text or '').lower()} ").encode()
        return [b[i : i + 4] for i in range(len(b) - 3)]

    r = random.Random(4)
    lexicon = {lang: ["".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(60)] for lang, letters in (("aa", "abcdeéor"), ("bb", "bcdefgñu"), ("cc", "aeioumnr"))}
    told = lambda lang, n: " ".join(r.choice(lexicon[lang]).title() + r.choice([" ", ", ", " 12 "]) for _ in range(n))
    train = [(i, told(lang, 50), lang, "s") for i in range(90) for lang in [("aa", "bb", "cc")[i % 3]]]
    p = langid.LanguageFilters(least_share=1e-3, slots=slots)
    f = langid.learn(spark.createDataFrame(rows_of(train), SCHEMA), p)
    known = {}
    for lang in f.langs:
        n = Counter(g for _, t, of, _ in train if of == lang for g in grams(t))
        known[lang] = {g for g, k in n.items() if k >= 1e-3 * sum(n.values())}
    texts = [(i, told("aa bb cc".split()[i % 3], 5 + i) + " " + told("aa bb cc".split()[(i + 1) % 3], 2), None, "s") for i in range(60)]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(rows_of(texts), SCHEMA), f).collect()}
    for i, t, _, _ in texts:
        all_ = grams(t)
        share = {lang: sum(g in known[lang] for g in all_) / len(all_) for lang in f.langs}
        assert got[i].score == pytest.approx(max(share.values()), abs=error)
        first, second = sorted(share.values(), reverse=True)[:2]
        assert got[i].lang_pred == max(share, key=share.get) or first - second < 2 * error


def test_filter_false_positives_are_rare_and_none_is_missed():
    import numpy as np

    table = np.zeros((1 << 14, 1), np.uint64)
    f = langid.BitSlicedFilter(("x", "y"), table, 3)
    own = np.arange(0, 4000, 2, dtype=np.uint32)
    for at in f.slots(own):
        table[at, 0] |= np.uint64(2)
    assert (f.which(own) == 2).all()
    others = np.arange(1, 400_001, 2, dtype=np.uint32)
    assert abs((f.which(others) == 2).mean() - f.false_rates()[1]) < 0.01 and f.false_rates()[0] == 0


def test_seventy_languages_and_marks_alone(spark):
    letters = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿāăąćĉċčďđēĕėęěĝğġģ"
    text = lambda k: " ".join(letters[k : k + 3] * 2 + letters[k + j % 3] for j in range(30))
    docs = spark.createDataFrame(rows_of([(i, text(i % 70), f"l{i % 70:02d}", "s") for i in range(280)]), SCHEMA)
    f = langid.learn(docs)
    assert len(f.langs) == 70 and f.table.shape[1] == 2
    got = langid.identify(docs, f, ("doc_id", "lang", "a.b")).collect()
    assert got[0].asDict().keys() == {"doc_id", "lang", "a.b", "lang_pred", "score"} and all(r["a.b"] == 5 for r in got)
    assert sum(r.lang_pred == r.lang for r in got) > 270
    marks = spark.createDataFrame(rows_of([(1, "\u0301\u0301 12", None, "s"), (2, "\u0301\u0301 12 \u00df", None, "s")]), SCHEMA)
    assert {r.doc_id: (r.lang_pred == "und", r.score == 0.0) for r in langid.identify(marks, f).collect()} [1] == (True, True)


def test_site_lines(spark, odd, empty):
    texts = [(i, f"own line {i}\nmenu | home\n\nbody {i % 7}", "en", "a") for i in range(30)] + [(100 + i, "menu | home", "en", "b") for i in range(3)] + [(200, "menu | home\nmenu | home", "en", "a")]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    out = {r.doc_id: r for r in linededup.drop_site_lines(docs).collect()}
    for i, t, _, s in texts:
        lines = t.split("\n")
        n = Counter((src, x) for _, y, _, src in texts for x in set(y.split("\n")))
        pages = Counter(src for *_, src in texts)
        kept = [x for x in lines if not x.strip() or not (n[s, x] >= 4 and n[s, x] > 0.05 * pages[s])]
        want = "\n".join(kept)
        assert out[i].text == want and out[i].n_lines == len([x for x in lines if x.strip()]), i
    assert (out[200].text, out[200].n_dropped) == ("", 2) and out[0].n_dropped >= 1 and "n_chars" in docs.columns
    shuffled = linededup.drop_site_lines(docs, p=linededup.SiteLines(small_keys=0))
    assert shuffled.select("doc_id", "text").exceptAll(spark.createDataFrame(list(out.values())).select("doc_id", "text")).count() == 0
    assert linededup.drop_site_lines(odd).count() == odd.count() and linededup.drop_site_lines(empty).count() == 0
    named = docs.withColumnsRenamed({"source": "gone", "row": "lines"}).withColumn("kept", F.lit("k")).withColumn("salt", F.lit(1)).withColumn("n_lines", F.lit("own"))
    for few in (0, 100):
        again = {r.doc_id: r for r in linededup.drop_site_lines(named, "gone", p=linededup.SiteLines(small_keys=few), counts=("had", "lost")).collect()}
        assert all((r.text, r.had, r.lost, r.kept, r.n_lines, r.lines) == (out[i].text, out[i].n_lines, out[i].n_dropped, "k", "own", "x") for i, r in again.items()) and len(again) == len(out)
    assert linededup.drop_site_lines(odd).where("doc_id = 3 AND text IS NULL AND n_lines = 0").count() == 1


def components_by_force(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size, small", [(2, 100_000), (5, 0)])
def test_near_duplicates(spark, size, small):
    texts = [(i, prose(i, 60)) for i in range(20)]
    for i in range(20, 80):  # a group around one text, edited more and more
        w = prose(500, 150).split()
        for k in range(0, 3 * (i % 8)):
            w[(k * 37 + i * 11) % 150] = f"w{i}x{k}"
        texts.append((i, " ".join(w)))
    texts += [(90, prose(500, 150)), (91, None), (92, ""), (93, "one"), (94, "ONE"), (95, " one\n")]
    docs = spark.createDataFrame(rows_of([(i, t, "en", "s") for i, t in texts]), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, docs, minhash.NearDuplicates(words=size, star=8, small_ids=small)).collect()}
    assert got == components_by_force(texts, size, 80)


def test_near_duplicates_odd(spark, odd, empty):
    out = minhash.near_duplicates(spark, odd).collect()
    assert len(out) == odd.count()
    assert {r.component_id for r in out if r.doc_id in (1, 2, -5)} == {-5} and all(r.kept for r in out if r.doc_id in (3, 4, 5))
    assert minhash.near_duplicates(spark, empty).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_shingles_of_few_words(size):
    import numpy as np

    from cohortlens.llm.vectext import word_hashes

    for texts in (["x"] * k for k in range(7)):
        for joined in ([" ".join(texts)], texts, ["", *texts], [" ".join(texts), "a b"]):
            raw = [t.encode() for t in joined]
            sets = list(minhash.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), size))
            hashes = [word_hashes(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in raw]
            assert [len(s) for s in sets] == [len({tuple(h[i : i + size]) for i in range(max(1, len(h) - size + 1))}) if len(h) else 0 for h in hashes]


def test_posterior_bound_prunes_almost_no_true_pair():
    p = minhash.NearDuplicates()
    for n, least in minhash.least_matches(p):
        missed = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(least))
        assert missed < 1e-5


def test_decontamination(spark, odd, empty):
    bench = spark.createDataFrame([(k, prose(900 + k, 20 + 9 * k), "x") for k in range(8)] + [(50, None, "x"), (51, "", "x"), (None, "words", "x")], "item_id long, text string, doc_id string")
    item = {k: prose(900 + k, 20 + 9 * k) for k in range(8)}
    texts = [(k, prose(k, 100) + " " + item[k].upper() + " " + prose(k + 50, 33), "en", "s") for k in range(8)]
    changed = {k: " ".join("zebra" if j % 8 == 3 else w for j, w in enumerate(item[k].split())) for k in range(8)}
    texts += [(100 + k, prose(k + 200, 77) + "\n" + changed[k], "en", "s") for k in range(8)]
    texts += [(200 + k, prose(k + 300, 400), "en", "s") for k in range(30)]
    texts += [(300, item[3] + " " + item[5], "en", "s"), (301, None, "en", "s"), (302, "", "en", "s")]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    got = {(r.doc_id, r.item_id) for r in semantic.contaminated(docs, bench).collect()}
    want = {(k, k) for k in range(8)} | {(100 + k, k) for k in range(8)} | {(300, 3), (300, 5)}
    assert got == want
    blocks = semantic.contaminated(docs, bench, semantic.Retrieval(block=3))
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == want
    assert semantic.contaminated(odd, bench).count() == 0 and semantic.contaminated(empty, bench).count() == 0 and semantic.contaminated(docs, bench.limit(0)).count() == 0


def test_thousands_of_items(spark):
    """Word-for-word and edited copies (three of four words kept) of any of 3000 items are found."""
    import random

    r = random.Random(8)
    known = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(6000)]
    text = lambda n: [known[min(int(r.paretovariate(0.5)) - 1, 10**9) % len(known)] if r.random() < 0.4 else r.choice(known) for _ in range(n)]
    item = {k: text(r.randint(12, 64)) for k in range(3000)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in item.items()], "item_id long, text string")
    texts, want = [], set()
    for i in range(400):
        k = r.randrange(3000)
        copy = item[k] if i % 2 else [r.choice(known) if j % 4 == 1 else w for j, w in enumerate(item[k])]
        texts.append((i, " ".join([*text(r.randint(0, 90)), *copy, *text(r.randint(0, 90))]), "en", "s"))
        want.add((i, k))
    texts += [(1000 + i, " ".join(text(300)), "en", "s") for i in range(40)]
    got = {(x.doc_id, x.item_id) for x in semantic.contaminated(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4), bench).collect()}
    assert got == want


def test_passage_of_a_long_item(spark):
    """64 words from anywhere in a long item are a passage of it; 20 are not."""
    item = [f"{w}{k % 61}" for k, w in enumerate(prose(70, 230).split())]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, prose(71, 200))], "item_id long, text string")
    starts = [0, 17, 48, 80, 111, 150, 166]
    texts = [(k, f"{prose(k, 60)} {' '.join(item[s : s + 64])} {prose(k + 90, 60)}", "en", "s") for k, s in enumerate(starts)]
    texts += [(100, f"{prose(5, 60)} {' '.join(item[40:60])} {prose(6, 60)}", "en", "s"), (101, " ".join(item), "en", "s"), (102, prose(72, 300), "en", "s")]
    # two ends of the item, and other words between: 140 of 230
    texts += [(103, " ".join([*item[:88], *prose(7, 45).split(), *item[142:]]), "en", "s")]
    got = {(x.doc_id, x.item_id) for x in semantic.contaminated(spark.createDataFrame(rows_of(texts), SCHEMA), bench).collect()}
    assert got == {(k, 1) for k in range(len(starts))} | {(101, 1), (103, 1)}


def test_common_subsequence():
    import random

    import numpy as np

    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 14))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert semantic.common_subsequence(np.array(a), np.array(b)) == t[-1][-1]


def test_personal_data(spark, odd, empty):
    texts = [
        "mail a.b@c.de-x.org, aa@b@cc.dd_e@f.g or @x.y at 999.1.1.1 and 10.0.0.255.7.8.9.1 end",
        "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559 4 4 4; +1 (408) 555-7800 ++12345678 +1 2",
        "IBAN DE89 3704 0044 0532 0130 00, DE89370400440532013001; SSN 078-05-1120 or 078-05-1121",
        "é" * 30 + "x@y.zz ümlaut +49 (0)30 901820 " + "9" * 3000 + " " + "1 " * 3000, None, "", "a" * 50_000 + "@b.c",
    ]
    docs = spark.createDataFrame(rows_of([(i, t, "en", "s") for i, t in enumerate(texts)]), SCHEMA)
    out = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.pii] for r in pii.find_personal_data(docs).collect()}

    def luhn(d):
        return sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub(r"\D", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    for i, t in enumerate(texts):
        if i == 6:
            assert out[i] == [("email", 0, len(t))]
            continue
        want = [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, t or "") if ok(m[0])]
        assert [s for s in out[i] if s[0] in pii.BASE] == want, i
    assert [s[0] for s in out[2] if s[0] not in pii.BASE] == ["iban", "ssn"]  # no word of context between the two numbers
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(empty).count() == 0


def test_sketches(spark, odd, empty):
    sets = [(i, list(range(i, i + n)), list(range(0, m))) for i, n, m in ((0, 3, 3), (1, 10, 14), (2, 0, 5), (3, 0, 0), (4, 40, 60), (5, 300, 280), (6, 5, 200))]
    df = spark.createDataFrame(sets, "id int, a array<long>, b array<long>")
    mixed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    df = df.select("id", "a", "b", mixed("a").alias("d_a"), mixed("b").alias("d_b"))
    for x in "ab":
        df = df.withColumn(f"cells_{x}", invertible.sketch(invertible.keyed(F.col(f"d_{x}"))))
    for r in invertible.differences(df, {"d": ("a", "b")}).collect():
        assert (r.d.only_a, r.d.only_b) == (len(set(r.a) - set(r.b)), len(set(r.b) - set(r.a))), r.id
    small = df.where("id < 4").select("*", invertible.peel(invertible.subtract(F.col("cells_a"), F.col("cells_b"))).alias("p"))
    assert all(r.p.whole for r in small.collect())
    out = invertible.fingerprint_edits(odd).collect()
    assert len(out) == odd.count() and invertible.fingerprint_edits(empty).count() == 0
    first, second = ([r for r in out if r.doc_id == k][0] for k in (1, 2))
    assert first.fingerprint == second.fingerprint and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)


def test_edits_by_force(spark):
    texts = {i: "\n".join(prose(40 * i + k, 20 + 30 * (k % 3)) for k in range(i % 12)) for i in range(0, 90, 3)}
    docs = spark.createDataFrame(rows_of([(i, t, "en", "s") for i, t in texts.items()]), SCHEMA)
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    cut = lambda t: {x.strip(" ") for x in re.findall(r"[^\n]{160,320}?[.!?](?= )|[^\n]+", t)} - {""}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in invertible.fingerprint_edits(docs).collect():
        t, u = texts[r.doc_id], texts[after[r.doc_id]]
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(cut(t), cut(edited))) and r.near_next == pytest.approx(like(cut(t), cut(u)))


def test_mixing(spark, odd, empty):
    docs = spark.createDataFrame(rows_of([(i, "t", "en", "big" if i % 10 else "small") for i in range(4000)]), SCHEMA)
    out = mixing.mix_sources(docs, mixing.Mixture(weights=(("big", 1.0), ("small", 3.0))))
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] - 3000) < 250 and abs(n["big"] - 1000) < 160  # about four deviations
    per = out.where("source = 'small'").groupBy("doc_id").count().collect()
    variance = sum((r["count"] - 7.5) ** 2 for r in per) + (400 - len(per)) * 7.5**2
    assert 0.7 < variance / 400 / 7.5 < 1.3
    parts = out.select("shuffle_key", F.spark_partition_id().alias("p")).collect()
    assert parts == sorted(parts, key=lambda r: (r.p, r.shuffle_key)) and out.columns[-2:] == ["copy", "shuffle_key"]
    odd_names = docs.withColumnsRenamed({"source": "rate", "row": "cdf"})
    weights = (("big", 1.0), ("small", 3.0))
    again = [mixing.mix_sources(odd_names, mixing.Mixture(weights=weights, small_sources=k), "rate").select("doc_id", "copy") for k in (0, 9)]
    assert all(x.exceptAll(out.select("doc_id", "copy")).count() == 0 and x.count() == out.count() for x in again)
    nulls = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "doc_id long, source string")
    assert {r.source for r in mixing.mix_sources(nulls, mixing.Mixture(weights=(("", 1.0),), growth=50.0)).collect()} == {""}
    assert mixing.mix_sources(odd, mixing.Mixture(growth=50.0)).select("source").distinct().count() == 3
    assert mixing.mix_sources(empty).count() == 0


def test_language_model(spark, odd, empty):
    texts = [(i, prose(i, 30 + i), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).select(F.col("doc_id").alias("row"), F.when(F.col("doc_id") % 5 == 0, 2).when(F.col("doc_id") % 5 == 1, 1).otherwise(0).alias("role"), "text")
    p = ngram_lm.Interpolation(chunk_bytes=600, bucket_tokens=64)
    got = {r.row: r for r in ngram_lm.score_texts(docs, p).collect()}
    tokens = {i: [*words(t), None] for i, t, *_ in texts}
    c = Counter(w for i, ws in tokens.items() if i % 5 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i].score < 0
    whole = {r.row: r.score for r in ngram_lm.score_texts(docs).collect()}  # in one chunk: the same
    assert all(whole[i] == pytest.approx(got[i].score) for i in whole)
    roled = lambda d: d.select(F.col("doc_id").alias("row"), F.lit(0).alias("role"), "text")
    assert ngram_lm.score_texts(roled(odd)).count() == odd.count() and ngram_lm.score_texts(roled(empty)).count() == 0


def test_model_by_force(spark):
    """Scores with the weights that the fit starts from, exactly; then with weights that
    expectation-maximisation over exact probabilities gives, within what rounding loses."""
    texts = [(i, prose(i % 37, 60), "en", "s") for i in range(120)]
    role = lambda i: (2, 1, 0, 0)[i % 4]
    docs = spark.createDataFrame([(i, role(i), t) for i, t, *_ in texts], "row long, role int, text string")
    pairs = {i: list(zip(["<s>", *words(t)], [*words(t), "</s>"], strict=True)) for i, t, *_ in texts}

    def counts(roles):
        two = Counter(x for i, ps in pairs.items() if role(i) in roles for x in ps)
        one, ctx = Counter(), Counter()
        for (v, w), n in two.items():
            one[w] += n
            ctx[v] += n
        return one, two, ctx, sum(one.values())

    size = len(counts((0, 1))[0]) + 1
    parts = lambda c, v, w: (c[1][v, w] / max(1, c[2][v]), c[0][w] / c[3], 1 / size)
    bucket = lambda n: min(15, int(math.log2(n)) + 1) if n else 0
    left_out = counts((0,))
    held = [(bucket(left_out[2][v]), parts(left_out, v, w)) for i, ps in pairs.items() if role(i) == 1 for v, w in ps]

    def fit(likely):
        w = [0.4, 0.4, 0.2]
        for _ in range(60):
            shares = [[x * y / sum(x * y for x, y in zip(w, like, strict=True)) for x, y in zip(w, like, strict=True)] for like in likely]
            w = [sum(s[j] for s in shares) / len(shares) for j in range(3)]
        return w

    pooled = fit([like for _, like in held])
    weights = {b: fit([like for k, like in held if k == b]) for b in {b for b, _ in held}}
    c = counts((0, 1))
    score = lambda ps, weigh: sum(math.log10(sum(x * y for x, y in zip(weigh(bucket(c[2][v])), parts(c, v, w), strict=True))) for v, w in ps)
    plain = {r.row: r.score for r in ngram_lm.score_texts(docs, ngram_lm.Interpolation(rounds=0)).collect()}
    assert all(plain[i] == pytest.approx(score(ps, lambda b: (0.4, 0.4, 0.2))) for i, ps in pairs.items())
    split = {r.row: r.score for r in ngram_lm.score_texts(docs, ngram_lm.Interpolation(rounds=0, chunk_bytes=600, bucket_tokens=500, hot_bytes=200)).collect()}
    assert all(split[i] == pytest.approx(plain[i]) for i in plain)
    fitted = {r.row: r.score for r in ngram_lm.score_texts(docs).collect()}
    assert all(fitted[i] == pytest.approx(score(ps, lambda b: weights.get(b, pooled)), rel=0.02) for i, ps in pairs.items())


def test_folds(spark):
    ids = spark.range(50).select(F.col("id").alias("doc_id"), langid.fold("id", 5).alias("f"))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in ids.collect())


def test_digest_spelling():
    assert archives.sha1_base32(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode() == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
