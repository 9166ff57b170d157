"""Quality rules, personal data, SentencePiece: scanners of single texts against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from ridgelog.llm.iforest import fit
from ridgelog.llm.pii import BASE, KINDS, find_spans, luhn, personal_data, redact_text, redacted
from ridgelog.llm.quality import RuleModel, accepted, base_failed, fit_rules, judge_quality, text_counts
from ridgelog.llm.queries import MODEL_PATH
from ridgelog.llm.sptok import build_tokenizer, decode, differing_texts, encode, parse_model, read_model

SF_DIR = "/root/testdata/sf0.01"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    again = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), len(lines)


def test_text_counts_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a a a a", "a\u00a0b c", "x\x0by\x1cz"]
    texts += ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "|", "\t"]) for _ in range(rng.randrange(80))) for _ in range(500)]
    assert [text_counts(t) for t in texts] == [brute_counts(t) for t in texts]


def test_forest_sets_strange_rows_apart():
    rng = np.random.default_rng(0)
    rows = rng.normal(0, 1, (2000, 3))
    odd = np.array([[6.0, 6.0, 6.0], [-7.0, 0.0, 7.0]])
    both = np.vstack([rows, odd])
    forest = fit(rows, both.min(axis=0), both.max(axis=0), trees=50)
    assert forest.scores(odd).min() > np.quantile(forest.scores(rows), 0.99)


def test_quality_rules_hold_out(spark):
    """A model of one half of the labelled documents judges the other half."""
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = fit_rules(docs, labels.where("doc_id % 2 = 0"))
    rows = judge_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) == 0
    assert all(r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"])


def test_quality_rules_base_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in judge_quality(docs, RuleModel(None, 1.0)).collect():
        counts = brute_counts(texts[r["doc_id"]])
        assert tuple(r)[1:6] == counts[:5]
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) == (not r["kept"])


def test_quality_rules_odd_tables(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, " ".join(f"w{i}" for i in range(60)), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 1), (9, 0), (1, 7)], "doc_id long, quality int")
    for marks in (labels, labels.where("false")):
        model = fit_rules(docs, marks)
        assert sorted((r["doc_id"] or 0, r["kept"]) for r in judge_quality(docs, model).collect()) == [(0, False), (1, False), (1, False), (2, True)]
        assert [tuple(r) for r in accepted(docs, model).collect()] == [rows[3]]
    assert judge_quality(docs.where("false"), model).count() == 0
    assert not base_failed(np.array([[50, 1, 0, 0, 25, 1]]))[0] and base_failed(np.array([[50, 1, 0, 0, 26, 1]]))[0]


_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    spans = []
    for kind, pattern in _PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((*m.span(), kind))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aA1209@.-+ ()é4%") for _ in range(rng.randrange(1, 50))) for _ in range(20000)]
    texts += ["1.2.3.4.5.6.7.8", "a@b.c@d.e", "999.1.1.1", "+1 (375) 555-4393", "4913187196670932", "1" * 3000 + ".1.1.1", None, ""]
    texts += [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    for t in texts:
        assert [s for s in find_spans(t) if s[2] in BASE] == brute_spans(t), t


@pytest.mark.parametrize(
    "text, redacted_text",
    [
        ('token = "186661156f3f99059"', 'token = "[SECRET]"'), ("password=569f672d50 the", "password=[SECRET] the"), ("see https://bob:pw@host.com/x", "see https://[LOGIN]/x"),
        ("IBAN: DE89 3704 0044 0532 0130 00 x", "IBAN: [IBAN] x"), ("IBAN: DE88 3704 0044 0532 0130 00 x", "IBAN: DE88 3704 0044 0532 0130 00 x"),
        ("ssn 123-45-6789", "ssn [SSN]"), ("account no. 12345678", "account no. [ACCOUNT]"), ("mail é me@x.org!", "mail é [EMAIL]!"), ("the token of a password", "the token of a password"), (None, None),
    ],
)
def test_redaction(text, redacted_text):
    assert redact_text(text) == redacted_text


@pytest.mark.parametrize("cue", ["ssn", "SSN", "Ssn", "SSNs", "social security", "Social Security", "SOCIAL SECURITY", "social-security", "Social_Security", "socialSecurity"])
@pytest.mark.parametrize("between", [" ", ": ", "# ", " number: ", " Number ", " no. ", " No: ", " nr. ", " is ", " number is ", "_number=", "Number = ", '": "', "-Nr.: ", " number (SSN): "])
def test_usual_spellings_of_social_security_numbers(cue, between):
    assert redact_text(f"é her {cue}{between}123-45-6789, and") == f"é her {cue}{between}[SSN], and"
    assert redact_text(f"{cue}{between}123-45-67890 {cue}{between}1123-45-6789") == f"{cue}{between}123-45-67890 {cue}{between}1123-45-6789"


@pytest.mark.parametrize("cue", ["API Key", "Api-Key", "apiKey", "ApiKey", "api key", "API_KEY", "Access Key", "accessKey", "Access-Key", "secretKey", "Secret Key", "PassWord", "İ Access Token"])
def test_usual_spellings_of_secrets(cue):
    assert redact_text(f"{cue}: 186661156f3f99059 {cue}='569f672d50' x") == f"{cue}: [SECRET] {cue}='[SECRET]' x"


def test_usual_spellings_of_accounts():
    assert redact_text("Iban No. DE89 3704 0044 0532 0130 00 x") == "Iban No. [IBAN] x"
    assert redact_text("accountNumber: 12345678, account_no=12345678, ACCOUNT is 12345678") == "accountNumber: [ACCOUNT], account_no=[ACCOUNT], ACCOUNT is [ACCOUNT]"
    assert redact_text("an account of 12345678, ssn 12-34, class 123-45-6789") == "an account of 12345678, ssn 12-34, class 123-45-6789"


def test_personal_data_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, "s"), (1, "a@b.cd", 6, "t"), (1, "a@b.cd", 6, "t")], "doc_id long, text string, n_chars long, spans string")
    assert sorted((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in personal_data(docs).collect()) == [(0, 0, ""), (1, 1, "email:0:6"), (1, 1, "email:0:6")]
    clean = redacted(docs)
    assert clean.columns == docs.columns and sorted((r["text"] or "", r["n_chars"] or 0) for r in clean.collect()) == [("", 0), ("[EMAIL]", 7), ("[EMAIL]", 7)]
    assert personal_data(docs.where("false")).count() == 0 and redacted(docs.where("false")).count() == 0


HARD = ["", "  ", " a", "a  b   c ", "<s>", "</s> <unk>", "<0x0A>", "\n\n\t x", "▁a ▁▁ b", "日本語テキスト", "😀 👩‍👩‍👧", "\u00a0nbsp\u3000em", "ｆｕｌｌ", "é", "x" * 5000, "   " * 100 + "y", "\r\n"]


def test_sentencepiece_parity(spark):
    texts = HARD + [c * n for c in " =-*ab" for n in range(1, 70)] + [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert differing_texts(read_model(MODEL_PATH), texts) == []


def test_sentencepiece_query_equals_the_library(spark):
    texts = HARD + [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(200).collect()]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, None, 0)], "doc_id long, text string, ids int")
    model = read_model(MODEL_PATH)
    rows = decode(encode(docs, model), model, text="back").collect()
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    by_id = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        assert by_id[i]["ids"] == own.encode(t) and by_id[i]["back"] == own.decode(own.encode(t)) and by_id[i]["exact"] == (by_id[i]["back"] == t)
    assert by_id[None]["ids"] == [] and by_id[None]["n_ids"] == 0
    assert encode(docs.where("false"), model).count() == 0


def test_texts_without_spaces_are_not_remembered():
    """Every text is one word; the memory of a task stays small, and ids and decoded texts are those of whole texts."""
    from ridgelog.llm.sptok import LONGEST_WORD, WordEncoder, decode_ids, encode_texts

    tokenizer = build_tokenizer(parse_model(read_model(MODEL_PATH)))
    encoder, rng = WordEncoder(tokenizer.to_str()), random.Random(2)
    for _ in range(4):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(20_000)) for _ in range(8)] + ["a few short words", "", "x" * 70 + " y", "short words a few"]
        ids, ends, back = encoder.encode(texts)
        whole = encode_texts(tokenizer, texts)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == whole and back == decode_ids(tokenizer, whole)
        assert max(map(len, encoder.number)) <= LONGEST_WORD and len(encoder.back) == len(encoder.number) < 20 and len(encoder.ids) <= 1 << 22


def test_unigram_models_are_rebuilt():
    """A hand-made unigram model with byte fallback, against the library that defines the format."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    pieces += [(p, -float(k + 1), 1) for k, p in enumerate(["▁", "a", "b", "c", "ab", "▁ab", "bc", "abc", "▁a", "cc"])]

    def field(number, kind, body):
        head = bytes([number << 3 | kind]) if number < 16 else bytes([number << 3 & 127 | kind | 128, number >> 4])
        return head + (bytes([len(body)]) if kind == 2 else b"") + body

    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    model += field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01")) + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x01") + field(5, 0, b"\x01"))
    assert parse_model(model).kind == 1 and build_tokenizer(parse_model(model)).get_vocab_size() == len(pieces)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    assert differing_texts(model, texts) == []
