import random
import time

from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, frame, rows
from vecspark.llm import licenses
from vecspark.llm.licenses import TEMPLATES, Template, find_licenses, patience


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_patience_gives_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(8) for _ in range(rng.randint(0, 14))]
        b = [rng.randrange(8) for _ in range(rng.randint(0, 14))]
        p = patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:], strict=False))
        assert len(p) <= lcs(a, b)
    a = rng.sample(range(100), 40)
    b = rng.sample(range(100), 40)
    assert len(patience(a, b)) == lcs(a, b)
    assert len(patience("the cat sat on the mat".split(), "the dog sat on the mat".split())) == 5


def test_every_template_is_found_in_noise(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join("x%d" % rng.randrange(50) for _ in range(n))
    data = [(i, f"{noise(30)}\n{t.text if i % 2 else t.text.upper()}\n{noise(30)}", None, None, None) for i, t in enumerate(TEMPLATES)]
    got = find_licenses(frame(spark, data).withColumn("license", F.lit(0)).withColumn("coverage", F.lit("c"))).collect()
    for i, t in enumerate(TEMPLATES):
        hits = [r for r in got if r["doc_id"] == i and r["license"] == t.license]
        assert hits and max(h["coverage"] for h in hits) == 1.0 and hits[0]["start_word"] == 30


def test_edits_and_repeats(spark):
    mit = "Released under the MIT License."
    data = [
        (1, " ".join([mit] * 3), None, None, None),
        (2, "Released, under the new MIT license", None, None, None),
        (3, "a license to read the MIT under-released", None, None, None),
        (4, None, None, None, None),
        (5, "", None, None, None),
        (None, mit, None, None, None),
        (7, "words " * 20000 + mit, None, None, None),
    ]
    got = sorted(((r["doc_id"], r["license"], r["start_word"], r["end_word"]) for r in find_licenses(frame(spark, data)).collect()), key=str)
    assert got == sorted([(1, "MIT", 0, 5), (1, "MIT", 5, 10), (1, "MIT", 10, 15), (2, "MIT", 0, 6), (None, "MIT", 0, 5), (7, "MIT", 20000, 20005)], key=str)


def test_other_templates_and_awkward_rows(spark):
    own = (Template("own", "zebra", "the zebra rule"),)
    assert [tuple(r)[1:] for r in find_licenses(frame(spark, [(1, "by the Zebra rule!", "", "", 0)]), own).collect()] == [("own", 1.0, 3, 1, 4)]
    assert find_licenses(frame(spark, rows())).collect() == []
    assert find_licenses(spark.createDataFrame([], DOCS)).collect() == []


def test_texts_without_any_one_word_are_found(spark):
    """Up to a fifth of a template's words may differ, whichever they are, unless they name the license."""
    rng = random.Random(3)
    data, want = [], set()
    for i, t in enumerate(TEMPLATES):
        words = t.text.split()
        naming = set(t.naming.split())
        for k, lost in enumerate(sorted({w.strip("().,;:").lower() for w in words}, key=len)[-3:]):
            at = [j for j, w in enumerate(words) if w.strip("().,;:").lower() == lost]
            if len(at) > len(words) // 10 or any(n in lost for n in naming):
                continue
            text = " ".join("qqq" if j in at else w for j, w in enumerate(words))
            data.append((3 * i + k, " ".join("x%d" % rng.randrange(50) for _ in range(30)) + " " + text, None, None, None))
            want.add((3 * i + k, t.license))
    got = {(r["doc_id"], r["license"]) for r in find_licenses(frame(spark, data)).collect()}
    assert len(want) >= 30 and want == got


def hits(text):
    return [(h.license, h.start, h.end) for h in SCANNER.scan(text.encode())]


SCANNER = licenses.Scanner(TEMPLATES)
BY_HAND = {
    "licensed under the BSD License": [],
    "Released under the Python License": [],
    "Licensed under the Apache License": [],
    "licensed under the same license as Perl": [],
    "Licensed under CC BY-SA 4.0.": [("CC-BY-SA-4.0", 0, 7)],
    "Licensed under CC BY-NC-SA 4.0.": [("CC-BY-NC-SA-4.0", 0, 8)],
    "Licensed under CC BY 4.0.": [("CC-BY-4.0", 0, 6)],
    "Licensed under CC BY 3.0.": [],
    "This work is licensed under the GNU Lesser General Public License, version 3": [("LGPL-3.0", 0, 13)],
    "This work is licensed under the GNU General Public License, version 2": [("GPL-2.0", 0, 12)],
}


def test_licenses_are_told_apart():
    for text, want in BY_HAND.items():
        assert hits(text) == want, text
    for t in TEMPLATES:
        assert [h[0] for h in hits(t.text)] == [t.license], t.text
    mit, isc, bsd = licenses._MIT_GRANT, licenses._ISC_GRANT, f"{licenses._BSD_TWO} {licenses._BSD_THIRD}"
    assert hits(mit.replace("sublicense", "sub-license")) == [("MIT", 0, 88)]
    assert [h[0] for h in hits(isc.replace("permission", "permision"))] == ["ISC"]
    assert [h[0] for h in hits(bsd.replace("endorse", "support"))] == ["BSD-3-Clause"]
    assert [h[0] for h in hits(mit[:250] + " and so on" * 20 + mit[250:])] == ["MIT"]
    assert [h[0] for h in hits(f"{mit} {isc} {bsd}")] == ["MIT", "ISC", "BSD-3-Clause"]


def test_seeds_lose_nothing_against_alignment_everywhere():
    """Findings of a version that aligns every template around every word."""
    rng = random.Random(8)
    some = [t for t in TEMPLATES if len(t.text.split()) < 60]
    for _ in range(60):
        parts = ["x%d" % rng.randrange(9) for _ in range(rng.randint(0, 12))]
        parts += [("zz" if rng.random() < 0.08 else w) for w in rng.choice(some).text.split() if rng.random() > 0.04]
        parts += ["x%d" % rng.randrange(9) for _ in range(rng.randint(0, 12))]
        words = licenses._WORD.findall(" ".join(parts).lower().encode())
        every = []
        for t in SCANNER.templates:
            far = 2 * len(t.words)
            for p in range(len(words)):
                for n in {len(t.words), len(t.words) + 6, far}:
                    for lo, hi in ((p, p + n), (p - n, p), (p - far, p + far)):
                        if h := SCANNER.align(words, t, max(0, lo), min(len(words), hi)):
                            every.append(h)
        want = {(h.license, h.start, h.end) for h in licenses.settle(every)}
        assert {h[0] for h in hits(" ".join(parts))} == {w[0] for w in want}


def test_long_texts_of_seeds_are_quick():
    began = time.time()
    SCANNER.scan(("permission is hereby granted to the mit license gnu general public " * 15000).encode())
    SCANNER.scan(b"licensed under the mit licence " * 30000)
    assert time.time() - began < 30
