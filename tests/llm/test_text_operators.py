"""Operators on single texts against plain versions of what they compute."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialoom.llm import language_id, pii, quality_classifier, quality_rules, sentencepiece_codec
from dialoom.llm.common import public_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\t#|é　\x1c", max_size=60))
def test_measures(text):
    assert quality_rules.measure_text(text)[:5] == plain_measures(text)


def test_ledger_on_odd_rows(odd, empty):
    got = quality_rules.apply_policy(quality_rules.ledger(odd))
    rows = got.collect()
    assert len(rows) == odd.count() and "score" not in got.columns
    assert {r.doc_id: r.n_words for r in rows}[2] == 0
    assert all(not r.kept for r in rows if r.n_words < 50)
    assert quality_rules.apply_policy(quality_rules.ledger(empty)).count() == 0


def test_ablation_is_the_policy_without_a_rule(documents):
    book = quality_rules.ledger(documents)
    rows = book.select("fail_bits").collect()
    for r in quality_rules.ablation(book).collect():
        bit, mask = 1 << list(quality_rules.RULES).index(r.rule), quality_rules.mask("v1")
        assert r.n_failed == sum(x.fail_bits & bit > 0 for x in rows)
        assert r.n_kept_without == sum(x.fail_bits & mask & ~bit == 0 for x in rows)


def test_op2_keeps_good_documents(spark, sf):
    got = quality_rules.op2_quality_rules(spark, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept or r.base_failed or r.doc_id not in good


def test_language_id_held_out(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    got = language_id.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert rows and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    model = language_id.fit(odd)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, model).collect()}
    assert found[1] == found[2] == found[3] == found[11] == ("und", 0.0)
    assert found[7][0] == "en" and found[13][0] == "fr"
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_text_without_a_letter_is_undetermined(documents):
    model = language_id.fit(documents)
    assert model.predict_text("½ ² ① Ⅷ 12") == ("und", 0.0)
    assert model.predict_text("½ a")[0] != "und"


def test_language_model_is_plain_naive_bayes(documents):
    rows = [(r.text, r.lang) for r in documents.collect() if r.lang and r.text]
    model = language_id.fit(documents)
    count, n = {}, Counter(lang for _, lang in rows)
    for text, lang in rows:
        letters = f" {re.sub(r'[^a-zA-ZÀ-ɏͰ-￿]+', ' ', text.lower()).strip()} "
        count.setdefault(lang, Counter()).update(np.concatenate(list(language_id.ngram_buckets(letters))).tolist())
    for text, _ in rows[::40]:
        grams = np.concatenate(list(language_id.ngram_buckets(text))).tolist()
        score = {}
        for lang, c in count.items():
            total = sum(c.values()) + 0.05 * language_id.BUCKETS
            score[lang] = math.log(n[lang] / len(rows)) + sum(math.log((c[g] + 0.05) / total) for g in grams)
        assert model.predict_text(text)[0] == max(sorted(score), key=score.get)


def test_ftrl_against_plain_updates():
    texts, labels = ["good clean prose of words", "BUY $$$ now now", "more prose of a kind", "$$$ $$$ win"] * 3, [1, 0, 1, 0] * 3
    z, n, w = Counter(), Counter(), {}
    alpha, beta, l1, l2 = 2.0, 1.0, 0.02, 0.01

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(4):
        for text, y in zip(texts, labels):
            x = {i: c / len(text.split()) for i, c in Counter(np.concatenate(list(quality_classifier.features(text))).tolist()).items()} | {0: 1.0}
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items()))) - y
            for i, v in x.items():
                step = (math.sqrt(n[i] + (g * v) ** 2) - math.sqrt(n[i])) / alpha
                z[i] += g * v - step * w[i]
                n[i] += (g * v) ** 2
    got = quality_classifier.train(texts, labels)
    assert {i: pytest.approx(weight(i), abs=1e-6) for i in z} == {i: float(got[i]) for i in z}
    assert np.count_nonzero(got) <= len(z)


def test_few_distinct_words_at_any_length(spark):
    text = lambda n, v: " ".join(f"word{i * i % v}" for i in range(n))
    docs = spark.createDataFrame([(n, text(n, 60)) for n in (4999, 5001, 20_000)], "doc_id long, text string")
    bit = 1 << list(quality_rules.RULES).index("few_distinct_words")
    assert all(r.fail_bits & bit for r in quality_rules.ledger(docs).collect())


def test_far_values_and_cases_of_cues():
    text = "IBAN of the account holder's own bank: FR14 2004 1010 0505 0001 3M02 606\nIBAN of the beneficiary: MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    assert [text[s:e] for s, e in pii.find(text)["iban"]] == ["FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    text = "iban AB12 CDEF 1234 5678 9012 then DE89 3704 0044 0532 0130 00; API key_of_a_very_long_name_indeed: abcdefgh12345678 HTTPS://user:pass@host.example"
    found = pii.find(text)
    assert [text[s:e] for s, e in found["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert [text[s:e] for s, e in found["secret"]] == ["abcdefgh12345678"] and "login" in found
    long = "x " * 300_000 + "a@b.de İ " + "y" * 100_000
    assert pii.find(long)["email"] == [(600_000, 600_006)]


def test_account_numbers_at_the_end_of_a_word():
    of = lambda t: [t[s:e] for s, e in pii.find(t).get("account", ())]
    assert of("account12345678") == ["12345678"] and of("account2 no. 1234 5678 x") == ["1234 5678"] and of("Konto-Nr 12345678") == []
    assert of("acct.  number: 12345678") == of("Kontonummer 12345678") == of("account123 12345678") == ["12345678"]
    assert of("account 1234567890 1234567890") == ["1234567890"] and of("account 1234567") == []


@pytest.mark.parametrize("part", ["token", "konto", "account  ", "token-", "a@", "@", "1.", "1", "+1(", "iban ", "https://a:", "12 ", "AB12 ", "account no"])
@pytest.mark.parametrize("head", ["", "account", "1.1", "iban", "+1", "token", "https://a:b"])
def test_time_in_proportion_to_length(head, part):
    """Four times the text takes no more than about four times the time: a quadratic parser would take 16 times, and far longer than this."""

    def took(n):
        text, best = head + part * n + "x", 9.0
        for _ in range(3):
            began = time.perf_counter()
            pii.find(text)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(20_000) < 9 * took(5_000) + 0.02


def test_spaces_after_a_cue():
    for cue in ("account", "token", "token:", "iban"):
        began = time.perf_counter()
        pii.find(cue + " " * 100_000 + "x")
        assert time.perf_counter() - began < 1


def test_sentencepiece_slices_and_unknown_pieces(monkeypatch, library):
    one = sentencepiece_codec.codec(sentencepiece_codec.MODEL)
    text = ("The quick  brown 日本 fox   jumps \U0001f600 " * 40).strip()
    monkeypatch.setattr(sentencepiece_codec, "_SLICE", 50)
    ids, _, spans = one.encode(text)
    assert ids == library.encode(text) and spans[-1, 1] == len(text.encode()) and (spans[1:, 0] == spans[:-1, 1]).all()
    raw = text.encode()
    for i, (a, b) in zip(ids, spans.tolist()):  # every piece's name is what stands in its place
        name = library.id_to_piece(i)
        assert library.is_byte(i) and name == f"<0x{raw[a]:02X}>" and b == a + 1 or name.replace("▁", " ").lstrip() == raw[a:b].decode().lstrip()


def test_sentencepiece_spans_of_an_unknown_piece(monkeypatch):
    one = sentencepiece_codec.Codec(sentencepiece_codec.MODEL)

    class Bare:  # a library without byte pieces: what it lacks is unknown
        def encode(self, part, out_type=int, **_):
            pieces = re.findall("[a-z▁]+|[^a-z▁]+", part)
            return pieces if out_type is str else [5 if p.isascii() or "▁" in p else 0 for p in pieces]

        def is_byte(self, i):
            return False

    monkeypatch.setattr(one, "bare", Bare())
    monkeypatch.setattr(one, "unknown", 0)
    assert one.encode("ab日本")[2].tolist() == [[0, 2], [2, 8]]


def test_language_scores_do_not_depend_on_pieces(monkeypatch, documents):
    model = language_id.fit(documents)
    text = documents.first().text
    whole = model.predict_text(text)
    monkeypatch.setattr(language_id, "_PIECE", 7)
    assert model.predict_text(text) == pytest.approx(whole)


def test_quality_classifier_held_out(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.op3_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert rows and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted for r in rows if r.quality == 1)
    weights = quality_classifier.fit(empty, labels.limit(0))
    assert {r.score for r in quality_classifier.classify(odd, weights).collect()} == {0.5}


def test_quality_of_every_learnt_label_where_labels_are_few(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.op3_quality_classifier(spark, sf).join(labels, "doc_id").where("quality IS NOT NULL").collect()
    assert {r.quality for r in rows} == {0, 1} and all(r.predicted == r.quality for r in rows)


def test_quality_rows_of_one_id_are_bounded(spark):
    good, bad = "a plain line of words that anyone may read at ease and with some joy too in the end of it all", "BUY $$$ now now " * 8
    docs = spark.createDataFrame([(1, f"{good} {i}") for i in range(300)] + [(2, f"{bad} {i}") for i in range(300)] + [(1, good)] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    weights = quality_classifier.fit(docs, labels, max_rows=60, shard=30)
    assert quality_classifier.score_text(weights, good) > 0.5 > quality_classifier.score_text(weights, bad)


def test_quality_features_do_not_depend_on_pieces(monkeypatch):
    text = "One two, two THREE!! one | two two three " * 9
    whole = np.sort(np.concatenate(list(quality_classifier.features(text))))
    monkeypatch.setattr(quality_classifier, "_PIECE", 5)
    assert (np.sort(np.concatenate(list(quality_classifier.features(text)))) == whole).all()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)


def test_quality_features_of_long_words_are_not_remembered():
    words = quality_classifier._Words()
    for word in ("a" * 64, "b" * 65, "Ж" * 9000, "b" * 65):
        assert words[word] == quality_classifier._Words()[word]
    assert list(words) == ["a" * 64]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n\tthe▁é日\U0001f600\x00\x1c　<s>0x"), max_size=40))
def test_sentencepiece_is_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    one = sentencepiece_codec.codec(sentencepiece_codec.MODEL)
    ids, decimal, spans = one.encode(text)
    assert ids == library.encode(text) and decimal == ",".join(map(str, ids))
    assert one.decode(ids) == library.decode(ids)
    if ids:  # the spans tile the text
        assert spans[0, 0] == 0 and spans[-1, 1] == len(text.encode()) and (spans[1:, 0] == spans[:-1, 1]).all()


def test_sentencepiece_query(spark, sf, library):
    got = {r.doc_id: r for r in sentencepiece_codec.op6_sentencepiece(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text)
        mine = got[r.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_sentencepiece_columns(odd, empty, library):
    df = odd.withColumn("e", sentencepiece_codec.encode(F.col("text")))
    for r in df.withColumn("back", sentencepiece_codec.decode(F.col("e.ids"))).collect():
        assert r.e.ids == library.encode(r.text or "") and r.back == library.decode(r.e.ids)
        assert len(r.e.starts) == len(r.e.ends) == len(r.e.ids)
    assert empty.select(sentencepiece_codec.encode(F.col("text"))).count() == 0


def test_compiled_character_map():
    """The map of a rule that the library compiles, against the library's own normaliser."""
    try:
        rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
        proto = rule.serialized_model_proto()
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"this library has no normaliser: {e}")
    blob = next(v for k, x, _ in sentencepiece_codec._fields(proto) if k == 3 for n, v, _ in sentencepiece_codec._fields(x) if n == 2)
    chars = sentencepiece_codec.CharacterMap(blob)
    for text in ("①Ａ ﬁ ガ ㌕ x", "plain", "éﷺ"):
        raw, at, out = text.encode(), 0, b""
        while at < len(raw):
            size, new = chars.longest(raw, at) or (0, b"")
            if not size:
                size = next(k for k in (1, 2, 3, 4) if at + k == len(raw) or raw[at + k] >> 6 != 2)
                new = raw[at : at + size]
            out, at = out + new, at + size
        assert out.decode() == rule.normalize(text)


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub(r"\D", "", m, flags=re.A)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub(r"\D", "", m, flags=re.A)) <= 15),
}


def plain_spans(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if ok(m.group())] for k, (p, ok) in BASE.items()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "+", "1", "25", "192.168.1.1", "4785380592391139", "4785 3805 9239 1139", "-", " ", "(", ")", "+1 (017) 555-7713", "x@y.com", "é", "\U0001f600", "_", "0", "\n", "٣"]), max_size=14).map("".join))
def test_base_spans(text):
    found = pii.find(text)
    assert {k: found.get(k, []) for k in BASE} == plain_spans(text)


def test_pii_query(spark, sf):
    for sf in (sf, "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        n = 0
        for r in pii.op10_pii(spark, sf).collect():
            plain = plain_spans(texts[r.doc_id])
            joined = ",".join(f"{k}:{s}:{e}" for k, v in plain.items() for s, e in v)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in plain.values()]
            n += len(joined) > 0
        assert n


def test_more_kinds_and_redaction(odd, empty):
    text = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" IBAN DE89 3704 0044 0532 0130 00 or account no: 12345678, https://me:pw@host.example/x a.b@c.de'
    found = pii.find(text)
    assert [text[s:e] for s, e in found["secret"]] == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert [text[s:e] for s, e in found["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert [text[s:e] for s, e in found["account"]] == ["12345678"]
    assert [text[s:e] for s, e in found["login"]] == ["me:pw@host.example"]
    masked = pii.redact_text(text)
    assert "12345678" not in masked and "a.b@c.de" not in masked and "[SECRET]" in masked
    assert pii.redact_text("clean text, 5 of them") == "clean text, 5 of them"
    assert odd.select(pii.redact(F.col("text")).alias("t")).where("t is null").count() == 1
    assert pii.scan(empty).count() == 0 and pii.scan(odd).count() == odd.count()
    assert zlib.crc32(b"") == 0 and public_vocabulary("x")


def test_every_language_is_learnt(spark):
    """More languages than a slice of the matrix has, those of the last slice as well as the first."""
    word = lambda k: "".join(chr(97 + (k * 7 + i * (k % 11 + 1)) % 26) for i in range(9)) + chr(0x400 + k)
    rows = [(3 * k + i, f"{word(k)} {word(k)} {i}", f"l{k:03}") for k in range(300) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 300 and language_id.SLICE < 300
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}
    assert model.predict_text(rows[-1][1])[0] == "l299"
