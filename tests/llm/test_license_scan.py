import random
import re

from quern.llm import license_scan as l


def plain(text, threshold=0.8):
    text = text or ""
    parts = {*text.split("\n"), *re.split(r"(?<=[.!?])\s+|\n", text), *re.split(r"\n\s*\n", text), text}
    best = {}
    for part in parts:
        own = l.plain_bigrams(part)
        for name, template in l.TEMPLATES.items():
            other = l.plain_bigrams(template)
            if own and (d := 2 * len(own & other) / (len(own) + len(other))) >= threshold - 1e-9:
                best[name] = max(d, best.get(name, 0))
    words = re.findall(r"[^\W_]+", text.lower())
    grams = list(zip(words, words[1:], strict=False))
    for name, template in l.TEMPLATES.items():
        other = l.plain_bigrams(template)
        inside = [g in other for g in grams]
        longest = int(len(other) * (2 - threshold) / threshold + 1e-9)
        if len(other & set(grams)) * (2 - threshold) < threshold * len(other) - 1e-9:
            continue
        for i in range(len(grams)):
            own = set()
            for j in range(i, min(len(grams), i + longest) if inside[i] else i):
                own.add(grams[j])
                if inside[j] and (d := 2 * len(own & other) / (len(own) + len(other))) >= threshold - 1e-9:
                    best[name] = max(d, best.get(name, 0))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = l.op7_license_scan(spark, sf).collect()
    assert len(rows) == len(docs) and any(r.n_licenses for r in rows)
    for r in rows:
        expected = plain(docs[r.doc_id])
        assert r.licenses == ",".join(n for n, _ in expected) and r.n_licenses == len(expected)
        assert r.dice == (round(expected[0][1], 9) if expected else None)


def test_edited_templates_and_odd_rows(spark):
    rng = random.Random(8)
    rows = [(0, None, "x"), (1, "", "x"), (2, "license " * 50_000, "x"), (3, "\n".join(["warranty"] * 3000), None), (4, "word " * 100_000 + "\n\n" + l.TEMPLATES["MIT"].replace(". ", ".\n") + "\n\nend", "x")]
    for name, text in l.TEMPLATES.items():
        for edits in range(0, 30, 3):
            words = text.split()
            for _ in range(min(edits, len(words) // 2)):
                words[rng.randrange(len(words))] = rng.choice(("foo", "the", "license"))
            rows.append((len(rows), f"Some prose first.\n{' '.join(words)}\nand more prose after it", "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = {r.doc_id: [(x.license, round(x.dice, 9)) for x in r.licenses] for r in l.scan_licenses(docs).collect()}
    for doc, text, _ in rows:
        assert got[doc] == [(n, round(d, 9)) for n, d in plain(text)]
    assert got[4][0][0] == "MIT" and l.scan_licenses(docs.limit(0)).count() == 0


def test_licence_of_paragraphs_within_a_longer_text(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(("river", "the", "of", "walks", "under", "software", "is")) for _ in range(n))
    broken = {n: re.sub(r"([.:;]) ", r"\1\n\n", t) for n, t in l.TEMPLATES.items()}
    rows = [(k, f"{prose(400)} {t}\n{prose(300)}" if k % 2 else f"{prose(90)}.\n\nTitle\n\n{t}\n\n{prose(500)}", n) for k, (n, t) in enumerate(broken.items())]
    rows += [(100 + k, f"{t} {prose(gap)} {t}", n) for k, (gap, (n, t)) in enumerate((g, x) for g in (5, 60, 200) for x in broken.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    for r in l.scan_licenses(docs).collect():
        assert [(x.license, round(x.dice, 9)) for x in r.licenses] == [(n, round(d, 9)) for n, d in plain(r.text)]
        assert r.name in {x.license for x in r.licenses}
