"""Fingerprints, personal data, licences and languages on the awkward corpus."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.fixtures import corpus, empty, frame
from tidemark.llm import blocks, fingerprints, languages, licenses, pii


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def order(row):
    return (-(row[0] if row[0] is not None else -(1 << 63)), row[1] is not None, row[1] or "")


def test_edited_texts_follow_the_order_of_ids(docs, rows):
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprint_edits(docs).collect()), key=str)
    falling, want = sorted(rows, key=order), []
    first_of = {}
    for r in falling:
        first_of.setdefault(r[0], r)
    for i, (d, t) in enumerate(falling):
        text, nxt = t or "", falling[(i + 1) % len(falling)][1] or ""
        cut = len(text) // 3
        want.append((d, len(text), hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_fingerprints(docs, rows):
    got = fingerprints.fingerprint_edits(docs).collect()
    text = {}
    for r in fingerprints.fingerprint_documents(docs).collect():
        text.setdefault(r.doc_id, r.fingerprint)
    by_text = {}
    own = {r.doc_id: r for r in got if r.doc_id is not None}
    for d, t in rows:
        if d in own and sum(x == d for x, _ in rows) == 1:
            assert by_text.setdefault(t or "", own[d].fingerprint) == own[d].fingerprint == text[d]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert own[1001].fingerprint == "" and own[1001].near_edited == 1.0
    unpack = lambda s: fingerprints.from_string(s).astype(np.int64)
    short = [r for r in got if len(r.fingerprint) < 4000]
    assert len(short) > 30
    for r in short:
        a, b = unpack(r.fingerprint), unpack(r.edited_fingerprint)
        assert r.near_edited == pytest.approx(plain_likeness(a, b) if len(a) and len(b) else float(len(a) == len(b)))
    single = sorted((r for r in got if r.doc_id is not None and sum(x == r.doc_id for x, _ in rows) == 1), key=lambda r: -r.doc_id)
    for r, nxt in zip(single, single[1:]):
        between = any(r.doc_id > (x if x is not None else r.doc_id) > nxt.doc_id for x, _ in rows)
        a, b = unpack(r.fingerprint), unpack(nxt.fingerprint)
        if not between and max(len(a), len(b)) < 500:
            assert r.near_next == pytest.approx(plain_likeness(a, b) if len(a) and len(b) else float(len(a) == len(b)))


def test_single_and_empty_tables(spark):
    r = fingerprints.fingerprint_edits(frame(spark, [(5, "abcdef")])).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and r[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    none = empty(spark)
    assert fingerprints.fingerprint_edits(none).collect() == []
    assert licenses.scan_licenses(none).collect() == []
    assert pii.detect_pii(none, pii.fit_spans(none)).collect() == []
    assert languages.identify_languages(none, languages.fit_languages(none)).collect() == []


def test_syncmers_depend_on_their_k_mer_alone():
    rng = random.Random(1)
    middle = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    a, b = fingerprints.sketches([middle, "x" * 37 + middle[:3000] + "tail"])
    assert fingerprints.likeness(a, b) > 0.5
    assert fingerprints.likeness(a, fingerprints.sketches([middle[::-1]])[0]) < 0.1
    assert np.array_equal(fingerprints.from_string(fingerprints.to_string(a)), a)
    # against a plain form on a short text
    k, s = fingerprints.K, fingerprints.S
    text = middle[:120]
    wide = blocks.mix(np.concatenate([fingerprints._PAD, np.frombuffer(text.encode("utf-32-le"), np.uint32)]).astype(np.uint64))
    inner = blocks.mix(fingerprints._polynomial(wide, s))
    places = [i for i in range(len(wide) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    values = {int(v) for v in blocks.mix(fingerprints._polynomial(wide, k)[places]) >> np.uint64(64 - fingerprints.BITS)}
    assert {int(h) for h in fingerprints.sketches([text])[0][:, 0]} == values


def test_fingerprints_are_compact_and_come_back_whole():
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20000))
    for t in ("", "a", "é", "a" * 5000, text, "z" * 3000 + text[:50] + "z" * 70000 + text[:900]):
        s = fingerprints.sketches([t])[0]
        assert np.array_equal(fingerprints.from_string(fingerprints.to_string(s)), s)
        assert (fingerprints.to_string(s) == "") == (t == "")
    apart = np.array([[7, 0], [3, 254], [3, 509], [9, 765], [2, 10**6]], np.uint32)
    apart = apart[np.lexsort((apart[:, 1], apart[:, 0]))]
    assert np.array_equal(fingerprints.from_string(fingerprints.to_string(apart)), apart)
    assert len(fingerprints.to_string(fingerprints.sketches([text])[0])) < 1.2 * len(text)
    whole, part = ({tuple(r) for r in fingerprints.sketches([text], n)[0].tolist()} for n in (1, 4))
    assert part < whole and 0.2 < len(part) / len(whole) < 0.3
    assert len(fingerprints.to_string(fingerprints.sketches([text], 4)[0])) < 0.3 * len(text)
    assert all(len(fingerprints.sketches([text[i : i + 20]], 1000)[0]) == 1 for i in range(50))


def plain_likeness(a, b):
    diagonals, left, right = collections.Counter(), collections.Counter(a[:, 0].tolist()), collections.Counter(b[:, 0].tolist())
    for h, p in a.tolist():
        for g, q in b.tolist():
            if h == g:
                diagonals[p - q] += 1
    return max(diagonals.values(), default=0) / (left | right).total()


def test_long_texts_keep_every_anchor():
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    shared = words(60)
    a, b = fingerprints.sketches([f"{words(1970)} {shared}", f"{words(500)} {shared} {words(1500)}"])
    assert len(a) > 2000 and len(b) > 2000
    assert len(set(a[:, 0].tolist()) & set(b[:, 0].tolist())) > 50
    assert fingerprints.likeness(a, b) > 0.01
    # repeated anchors stay with each of their places
    assert len(fingerprints.sketches([(shared + " ") * 10])[0]) > 8 * len(fingerprints.sketches([shared])[0])


@pytest.mark.parametrize("dense", [0, 16])
def test_likeness_counts_repeats(monkeypatch, dense):
    monkeypatch.setattr(fingerprints, "DENSE", dense)
    monkeypatch.setattr(fingerprints, "PAIRS", 100)
    rng = random.Random(5)
    line = "".join(rng.choice("abcdefgh ") for _ in range(40))
    texts = [line * 6, "x" * 11 + line * 4 + "tail", "a" * 90, "a" * 70 + line, line[:20] + "q", line[::-1] * 3]
    found = fingerprints.sketches(texts)
    for x in found:
        for y in found:
            assert fingerprints.likeness(x, y) == pytest.approx(plain_likeness(x, y))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("a1@.+- (2)7\n%é") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t)


def test_spans_keep_the_base_and_find_other_forms(spark):
    texts = ["call 0049 (212) 555-0100 now", "mail jo.doe (at) example.org", "+1 (269) 555-3296 4524132264652876 end", "on 2020-01-02 12.30 at 5", "é 10.0.0.1, a@b.co", None, "", "4524132264652877"]
    rows = list(enumerate(texts))
    field = pii.fit_spans(frame(spark, rows))
    got = {r.doc_id: r for r in pii.detect_pii(frame(spark, rows), field, masked=True).collect()}
    for i, t in rows:
        base = pii.join_spans(plain_spans(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert "card:18:34" in got[2].spans and "phone:0:17" in got[2].spans
    assert got[1].spans == "email:5:28" and got[1].masked == "mail [EMAIL]"
    assert got[3].spans == "" and got[7].spans == "" and got[5].masked is None


def test_segmentation_is_the_best_one():
    """Dynamic programming against all segmentations of short stretches."""
    field = pii.SpanField({"phone:length": 3.0, "card:length": 2.5, "card:luhn": 4.0, "phone:noplus": -1.0, "ip:quad": 5.0})
    for text in ("4524132264652876 123456789", "1.2.3.4 123456789 12", "123456789-123456789"):
        for stretch in pii.stretches(text):
            score = field.scores(stretch)

            def best(at, stretch=stretch, score=score):
                return max([0.0] + [score[k] - pii.MARGIN + best(s[1]) for k, s in enumerate(stretch.segments) if s[0] >= at])

            chosen = field.decode(stretch)
            value = sum(score[k] - pii.MARGIN for k, s in enumerate(stretch.segments) if (stretch.cuts[s[0]], stretch.cuts[s[1]], s[2]) in chosen)
            assert value == pytest.approx(best(0))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licence_places_match_plain_python(spark, rows):
    rng = random.Random(7)
    bits = ["GNU General", "Public License", "apache LICENSE", "cc", "BY", "mit license", "MIT", "é", "gnu general public license", ",", "\n", "cc-by 4.0", "word"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(80)] + [None, ""]
    data = list(enumerate(texts))
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, data)).collect()}
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for i, t in data:
        w = WORD.findall((t or "").translate(low))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_licence_expressions():
    post = licenses.to_postfix("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0")
    assert post == ["MIT", "Apache-2.0", "or", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and"]
    names, weight = licenses.evaluate(post)
    assert names == {"mit", "apache", "gpl"} and weight == pytest.approx(0.4)
    for bad in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT Apache-2.0", "()"):
        with pytest.raises(ValueError):
            licenses.to_postfix(bad)
    scan = lambda raw: licenses.scan_text(raw, licenses.build_automaton())["labels"]
    assert scan(b"SPDX-License-Identifier: see mitigation notes") == "" and scan(b"SPDX-License-Identifier: bsdiff AND isces") == ""
    assert scan(b"SPDX-License-Identifier: GPLv3 or Apache-2.0") == "apache,gpl" and scan(b"SPDX-License-Identifier: CC-BY-SA-4.0") == "cc-by,cc-by-sa"
    assert scan(b"SPDX\n * License ... Identifier: MIT") == "mit" and scan(b"xspdx-license-identifier: MIT") == ""
    assert scan(b"Creative Commons Attribution-NonCommercial 4.0") == "cc-by-nc"
    assert scan(b"Creative Commons Attribution 4.0") == "cc-by" and scan(b"Creative Commons Attribution-ShareAlike") == "cc-by-sa"
    r = licenses.scan_text(b"// SPDX-License-Identifier: MIT OR GPL-3.0-or-later\nx", licenses.build_automaton())
    assert r["labels"] == "gpl,mit" and r["obligation"] == pytest.approx(0.1) and r["score"] > 0.9
    assert licenses.scan_text(b"SPDX-License-Identifier: (MIT", licenses.build_automaton())["labels"] == "mit"


def language_rows(n=60):
    rng = random.Random(3)
    parts = {"aa": ["ba", "lo", "mi", "tra", "ne"], "bb": ["zu", "kor", "ish", "ven", "äx"], "cc": ["qui", "ou", "eau", "ré", "èt"]}
    out = []
    for i in range(n):
        lang = "abc"[i % 3] * 2
        out.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    return out


def test_languages(spark):
    data = language_rows()
    df = spark.createDataFrame([(i, t, lang if i % 7 else None) for i, t, lang in data] + [(900, None, "aa"), (901, "", "bb"), (902, "12 !! 34", "cc"), (903, "漢字" * 40, None)], "doc_id long, text string, lang string")
    model = languages.fit_languages(df)
    got = {r.doc_id: r for r in languages.identify_languages(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in data)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].rejected and got[903].lang_pred in ("aa", "bb", "cc")
    assert not any(got[i].rejected for i, _, _ in data)


def test_kneser_ney_sums_to_one_and_matches_a_plain_form():
    texts = [("abab ba", "x"), ("abba", "x"), ("bbb", "y")]
    model = languages.LanguageModels.fit(texts)
    n = languages.ORDER

    def plain(name):
        own = [" " * (n - 1) + t for t, lang in texts if lang == name]
        grams = {k: {} for k in range(1, n + 1)}
        for t in own:
            for i in range(n - 1, len(t)):
                grams[n][t[i - n + 1 : i + 1]] = grams[n].get(t[i - n + 1 : i + 1], 0) + 1
        for k in range(n - 1, 0, -1):
            longer = {t[i - k : i + 1] for t in own for i in range(n - 1, len(t))}
            for g in longer:
                grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
        return grams

    symbols = {c for t, _ in texts for c in t}

    def p(grams, context, c, k):
        if k == 0:
            return 1 / (len(symbols) + 1)
        counts = grams[k]
        n1, n2 = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
        off = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = {g: v for g, v in counts.items() if g[:-1] == context[len(context) - k + 1 :]}
        low = p(grams, context, c, k - 1)
        total = sum(own.values())
        if not total:
            return low
        return max(own.get(context[len(context) - k + 1 :] + c, 0) - off, 0) / total * (own.get(context[len(context) - k + 1 :] + c, 0) > 0) + off * len(own) / total * low

    for text in ("abab ba", "bab", "zab", "ab b"):
        got, _, _ = model.entropies(*blocks.text_buffer(__import__("pyarrow").array([text])))
        for j, name in enumerate(model.names):
            grams, padded = plain(name), " " * (n - 1) + text
            want = -np.mean([np.log(p(grams, padded[i - n + 1 : i], padded[i], n)) for i in range(n - 1, len(padded))])
            assert got[0, j] == pytest.approx(want, rel=1e-4)
