import re
from collections import defaultdict

import xxhash

from brevis.llm import linededup as L
from tests.conftest import SF

from .fixtures import PROSE, empty_documents, odd_documents

BREAK = re.compile(r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
WS = " \t\n\x0b\x0c\r"


def lines(text):
    cuts = [m.start() for m in BREAK.finditer(text)]
    cuts = [c for c in cuts if re.search(r"[.!?\n][\x20\x09-\x0D]{1,8}$|\n$", text[max(0, c - 9) : c])]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]


def h64(x):
    v = xxhash.xxh64_intdigest(x.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def former(docs, w=L.WINDOW, reach=L.REACH):
    """The rule until round 1: window minima, matched with their first position in the corpus alone and extended by three lines.
    It loses repeats, so it is a lower bound now; `exact` is the present rule's brute force."""
    key = lambda d: (-(1 << 63) if d[0] is None else d[0], h64(d[1]))
    hashes, first, all_at = {}, {}, defaultdict(set)
    for d in docs:
        if d[1] and d[1].strip(WS):
            hs = hashes[key(d)] = [h64(x.strip(WS)) for x in lines(d[1])]
            for i in range(max(1, len(hs) - w + 1)):
                part = hs[i : i + w]
                p = i + max(k for k, v in enumerate(part) if v == min(part))
                all_at[hs[p]].add((*key(d), p))
    first = {h: min(v) for h, v in all_at.items()}
    out = []
    for d in docs:
        if key_hs := d[1] and d[1].strip(WS) and hashes[key(d)]:
            hs, units, gone = key_hs, lines(d[1]), set()
            for h in set(hs):
                for a, b, p in all_at.get(h, ()):
                    if (a, b) != key(d) or first[h] == (a, b, p):
                        continue
                    oa, ob, q = first[h]
                    ho = hashes[oa, ob]
                    x = y = p
                    while p - x < reach and x > 0 and q - (p - x) > 0 and hs[x - 1] == ho[q - (p - x) - 1]:
                        x -= 1
                    while y - p < reach and y + 1 < len(hs) and q + y - p + 1 < len(ho) and hs[y + 1] == ho[q + y - p + 1]:
                        y += 1
                    if sum(1 + u.strip(WS).count(" ") for u in units[x : y + 1]) >= L.LEAST_WORDS:
                        gone.update(range(x, y + 1))
            out.append((d[0], "".join(u for i, u in enumerate(units) if i not in gone), len(gone)))
        else:
            out.append((d[0], d[1], 0))
    return out


def order(rows):
    return sorted(((*r,) for r in rows), key=str)


def test_lines_are_the_text(spark):
    from pyspark.sql import functions as F

    texts = ["a. b\nc  d.\n\n e!? f", "\n\nx", "no end", "one.two three. "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for t, r in zip(texts, df.select(L.lines(F.col("text"))).collect()):
        assert "".join(r[0]) == t and r[0] == lines(t)


def test_passage_inside_other_text_goes_once(spark):
    passage = " ".join(f"Every word{i} of passage{i} stays in place{i} here." for i in range(9))
    rows = [(1, "Some own words come first. " + passage + " And own words end it."), (2, "Other words that begin it. " + passage + " Then it goes on."), (3, "Nothing shared in this one at all, really.")]
    got = {r.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]
    assert got[2] == "Other words that begin it. Then it goes on."


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = L.line_dedup(docs).collect()
    assert order(got) == order(former([(r.doc_id, r.text) for r in docs.collect()]))
    assert L.keep_first(docs).columns == docs.columns and L.keep_first(docs).count() == docs.count()
    assert L.line_dedup(empty_documents(spark)).collect() == [] and PROSE


def exact(docs, least=L.LEAST_WORDS):
    """Lines in a run of `least` words (by the test's own count) that occurs earlier, each run compared as a whole."""
    key = lambda d: (-(1 << 63) if d[0] is None else d[0], h64(d[1]))
    held = {key(d): lines(d[1]) for d in docs if d[1] and d[1].strip(WS)}
    at = defaultdict(set)
    for k, units in held.items():
        bare = [u.strip(WS) for u in units]
        for i in range(len(bare)):
            for j in range(i, min(i + least + 1, len(bare))):
                if sum(len(u.split()) for u in bare[i : j + 1]) >= least:
                    at["\n".join(bare[i : j + 1])].add((k, i, j))
    gone = defaultdict(set)
    for found in at.values():
        for k, i, j in found - {min(found)}:
            gone[k].update(range(i, j + 1))
    out = []
    for d in docs:
        g = gone[key(d)] if d[1] and d[1].strip(WS) else ()
        out.append((d[0], "".join(u for i, u in enumerate(held[key(d)]) if i not in g) if g else d[1], len(g)))
    return out


def cleaned(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in L.line_dedup(rows).orderBy("doc_id").collect()]


def test_all_repeated_runs_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = exact(rows)
    assert order(L.line_dedup(docs).collect()) == order(want)
    # all that the former rule took goes too
    assert all(new >= old for (_, _, new), (_, _, old) in zip(want, former(rows)))


def test_frequent_lines_keep_their_other_contexts(spark):
    # each short line's first position stands alone, in a document of its own
    short = ["Alpha one.", "Beta two.", "Gamma three.", "Delta four.", "Epsilon five.", "Zeta six."]
    passage = " ".join(short)
    got = cleaned(spark, *short, "Own words come first. " + passage + " Own end.", "Other words begin. " + passage + " Other end.")
    assert got[7] == "Other words begin. Other end." and got[6].count(passage) == 1


def test_single_long_lines_go(spark):
    texts = [[], []]
    for i in range(20):
        for side, text in enumerate(texts):
            text += [f"Own{side}x{i}n{j} is here." for j in range(4)]
            text.append(" ".join(f"w{i}n{j}" for j in range(60)) + ".")
    got = cleaned(spark, *(" ".join(t) for t in texts))
    assert got[0] == " ".join(texts[0]) and " w" not in got[1] and got[1].count("Own1x") == 80


def test_words_without_blanks_count(spark):
    table = "\n".join("\t".join(f"r{i}c{j}" for j in range(5)) for i in range(20)) + "\n"
    hard = "\u00a0".join(f"hard{j}" for j in range(9)) + ".\n"
    han = "".join(chr(0x4E00 + 7 * j) for j in range(20)) + ".\n"
    comma = ",".join(f"cell{j:03}" for j in range(25)) + ".\n"
    few = "one  two   three    four\n"
    shared = [table, hard, han, comma, few]
    got = cleaned(spark, *(f"Own words of {side} that come first here.\n{x}Own {side} ends {i} of all texts that were given.\n" for i, x in enumerate(shared) for side in ("a", "b")))
    assert [x in got[2 * i] for i, x in enumerate(shared)] == [True] * 5
    # few words with many blanks between them are still few
    assert [x in got[2 * i + 1] for i, x in enumerate(shared)] == [False] * 4 + [True]
    assert not any(f"r{i}c" in got[1] for i in range(20))


def test_runs_are_whole(spark):
    """A run whose lines occur first in many unrelated texts, one-word lines, and a very long run."""
    parts = [f"Line{i} has its own eight words for line{i}." for i in range(12)]
    firsts = [f"Own{i} of all the others is here first. {p} Then own{i} ends it." for i, p in enumerate(parts)]
    single = "\n".join(f"single{i}" for i in range(60)) + "\n"
    table = "\n".join(f"row{i} of a long table" for i in range(5_000)) + "\n"
    rows = [*firsts, "Origin. " + " ".join(parts) + " End of it.", "Copy begins. " + " ".join(parts) + " Copy ends.", "A list:\n" + single + "Last of a.\n", "The list:\n" + single + "Last of b.\n", "Begin a.\n" + table + "End a.\n", "Begin b.\n" + table + "End b.\n"]
    got = cleaned(spark, *rows)
    assert got[13] == "Copy begins. Copy ends." and got[15] == "The list:\nLast of b.\n" and got[17] == "Begin b.\nEnd b.\n"
    assert got[:12] == firsts and got[14] == rows[14] and got[16] == rows[16]
