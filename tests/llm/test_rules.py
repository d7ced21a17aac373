import math
import re
import unicodedata
import zlib
from collections import Counter

from brevis.llm import rules
from tests.conftest import SF

from .fixtures import empty_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered, seen, dup = Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 20 or 100 * r > 30 * n


def test_base_counts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = rules.quality_rules(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_distance_matches_its_definition(spark):
    from pyspark.sql import functions as F

    p, q = [3, 0, 5, 2], [1, 1, 0, 8]
    a, b = [x / 10 for x in p], [x / 10 for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b)]
    kl = lambda u, v: sum(x * math.log2(x / y) for x, y in zip(u, v) if x)
    df = spark.createDataFrame([(p, q)], "p array<long>, q array<long>")
    got = df.select(rules.distance(F.col("p"), F.col("q"))).first()[0]
    assert abs(got - math.sqrt((kl(a, m) + kl(b, m)) / 2)) < 1e-12


def brute_histograms(text, lang):
    text = text or ""
    at = [0] * 6
    for c in text:
        kind = unicodedata.category(c)
        if kind == "Lu":
            k = 1
        elif kind[0] == "N":
            k = 2
        elif c in " \t\n\x0b\x0c\r":
            k = 3
        elif c in ".,;:!?'\"()-":
            k = 4
        elif c in "#*$%&|<>@^_~=+/\\{}[]":
            k = 5
        else:
            k = 0
        at[k] += 1
    known = rules.COMMON.get(lang)
    if not known:
        return at, None
    found = [w for w in re.split(r"[\x20\x09-\x0D.,;:!?'\"()\-]+", text.lower()) if w]
    n = Counter(found)
    return at, [*(n[w] for w in known), len(found) - sum(n[w] for w in known)]


def jsd(p, q):
    if not p or not q or not sum(p) or not sum(q):
        return None
    a, b = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b)]
    kl = lambda u: sum(x * math.log2(x / y) for x, y in zip(u, m) if x)
    return math.sqrt(max(0, (kl(a) + kl(b)) / 2))


def check_verdicts(docs):
    rows = [(r.doc_id, r.text or "", r.lang if r.lang in rules.COMMON else "") for r in docs.collect()]
    sums, hists = {}, []
    for _, text, lang in rows:
        h = brute_histograms(text, lang)
        hists.append(h)
        total = sums.setdefault(lang, ([0] * 6, [0] * 21 if lang else None))
        for t, x in zip(total, h):
            if x:
                t[:] = [u + v for u, v in zip(t, x)]
    want = []
    for (i, text, lang), (at, common) in zip(rows, hists):
        n_words, *_, failed = base(text)
        chars = jsd(at, sums[lang][0]) if len(text) >= rules.LEAST_CHARS else None
        far = jsd(common, sums[lang][1]) if n_words >= rules.LEAST_WORDS else None
        bad = (chars or 0) > rules.CHAR_LIMIT or (far is not None and far > math.sqrt(rules.WORD_LIMIT**2 + 20 / (8 * math.log(2) * n_words)))
        want.append((i, chars, far, not failed and not bad))
    shown = lambda x: None if x is None else round(x, 9)
    order = lambda found: sorted(((i, shown(c), shown(f), k) for i, c, f, k in found), key=str)
    assert order((r.doc_id, r.jsd_chars, r.jsd_words, r.kept) for r in rules.quality_rules(docs).collect()) == order(want)


def test_histograms_and_verdicts_match_brute_force(spark):
    check_verdicts(spark.read.parquet(f"{SF}/documents.parquet"))
    check_verdicts(odd_documents(spark))


def test_verdict_on_labels_that_set_no_limit(spark):
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rest = [r for r in rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect() if zlib.crc32(str(r.doc_id).encode()) % 2 and not r.base_failed]
    good, junk = ([r.kept for r in rest if labels.get(r.doc_id) == q] for q in (1, 0))
    assert len(junk) > 5 and sum(good) >= 0.99 * len(good) and sum(junk) <= 0.2 * len(junk)


def test_verdict_agrees_with_quality_labels(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").collect()
    good, junk = [r for r in got if r.quality == 1 and not r.base_failed], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in junk) >= 0.7 * len(junk)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = rules.quality_rules(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[2].n_words == 0 and by[2].base_failed and by[3].word_chars == 0 and by[6].n_dup_lines == 0
    assert by[7].n_repeat_words == 40_000 and not by[7].kept
    assert rules.keep_good(docs).columns == docs.columns
    assert rules.quality_rules(empty_documents(spark)).collect() == []
    assert rules.keep_good(empty_documents(spark)).collect() == []
