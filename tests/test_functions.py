import html
import json
import re
import unicodedata
import uuid
from datetime import date

from pyspark.sql import functions as F

from lexspan.functions import classify, ids, text, vectors

ODD = ["Straße ẞ", "ΣΑΣ ς", "ﬁn İI ŉ ǰ", "Điều 1 ỨNG", "é Å", "Ångström Å", "a b c\x1cd", "", "   ",
       "Ꭰꭰ ᲀ", "x²³ ½ _y", "日本語 テスト", None, "“quoted” — text…", "ΐ ΰ ᾳ"]


def test_casefold_norm_and_tokens_match_python(values):
    assert values(ODD, text.casefold) == [t if t is None else t.casefold() for t in ODD]
    norm = [" ".join(unicodedata.normalize("NFC", t or "").casefold().split()) for t in ODD]
    assert values(ODD, text.norm) == norm
    assert values(ODD, text.tokenize) == [re.findall(r"[\wÀ-ỹ]+", (t or "").casefold()) for t in ODD]
    assert values(ODD, text.prepare_text) == [" ".join(unicodedata.normalize("NFC", t or "").split()) for t in ODD]


def test_entities_match_python(values):
    cases = ["a &amp; b", "&amp;lt;", "R&D", "&eacute;&hellip;", "&#233; &#x41;", "&copy 2020", "plain", "&nbsp;x&middot;&quot;", None]
    assert values(cases, text.decode_entities) == [c if c is None else html.unescape(c) for c in cases]


def test_fingerprint_and_visible_text(values):
    assert values(["<p>&nbsp;</p><!-- junk --><script>x()</script>", "<p>Điều 1</p><p> A &amp; B </p>", "<TITLE>t</TITLE>x&eacute;<br>y"],
                  text.text_fingerprint) == ["", "Điều 1 A & B", "xé y"]
    shown = ["<p>la<span>o</span> động &amp; nghỉ</p>", "<p>A</p><p>B</p>", "a<br/>b<b>c</b>", "&lt;p&gt; R&D</p>", "x &hellip; <i>y</i>",
             "<head><title>no</title></head><div>yes</div>", "A & <b>x</b>; y", None]
    assert values(shown, text.visible_text) == ["lao động & nghỉ", "A B", "a bc", "<p> R&D", "x … y", "yes", "A & <b>x</b>; y", ""]


def test_excerpt_clip(values):
    cases = ["abc def ghi", "abcdefghijkl", " abcdefghijk", "short"]
    assert values(cases, lambda c: text.clip_excerpt(c, 9)) == ["abc def", "abcdefghi", " abcdefgh", "short"]


def test_identifiers(values):
    assert values(["Điều/1", "a"], ids.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in ("Điều/1", "a")]
    assert values(["x"], lambda c: ids.stable_id(c, F.lit(7), prefix="p")) == [str(uuid.uuid5(uuid.NAMESPACE_URL, "p:x:7"))]
    days = ["2024-01-01", "2024-13-01", "01/02/2024", None, "2023-02-30"]
    assert values(days, ids.iso_ordinal) == [date(2024, 1, 1).toordinal(), None, None, None, None] and date(2024, 1, 1).toordinal() == 738886
    assert values([["a", 'q"'], []], ids.json_list, "array<string>") == ['["a", "q\\""]', "[]"]


def test_scope_and_issuer(values):
    scopes = ["  TRUNG   ƯƠNG ", "Tuyên Quang", "Toàn quốc", None, "Tỉnh An Giang", "Huyện A"]
    assert values(scopes, classify.scope_reason) == ["central_exact", "exclude_local_scope", "quarantine_unrecognized_scope",
                                                     "quarantine_missing_scope", "exclude_local_scope", "exclude_local_scope"]
    issuers = ["Bộ Tài chính, UBND tỉnh An Giang", "Ngân hàng Nhà nước Việt Nam, Chưa xác định", "Bộ Tài chính", "", "Công ty A", "Thành uỷ X"]
    assert values(issuers, classify.issuer_signal) == ["local_issuer_signal", "missing_or_unknown_issuer", "central_issuer_signal",
                                                       "missing_or_unknown_issuer", "unrecognized_issuer", "local_issuer_signal"]


def test_topics_reasons_and_labels(values):
    assert values(["Hợp đồng THỬ VIỆC", "Nghỉ lễ", "khác"], classify.topic_candidates) == [["probation", "contracts"], ["leave"], []]
    none = F.lit(None).cast("string")
    assert values(["Bộ luật Lao động", "Hợp đồng", "Hợp đồng lao động"], lambda c: classify.employment_reasons(c, F.lit("Lao động"), none)) == [
        ["bộ luật lao động"], ["labor_context_for_contract"], ["hợp đồng lao động", "labor_context_for_contract"]]
    assert values(["ĐIỀU 24a. X", " Article 3", "Chương 1"], classify.article_number) == ["24a", "3", None]
    assert values(["http://a.b/c", "ftp://a", "https://u:p@h/", "https:///x", "HTTPS://h:8/"], classify.safe_url) == [
        "http://a.b/c", None, None, None, "HTTPS://h:8/"]


def test_upstream_errors(values):
    none = F.lit(None).cast("string")
    said = ["bad json schema here", "max_tokens too big", "Invalid API key", "rate limit hit", "model not found", "x", None]
    assert values(said, lambda c: classify.upstream_error_class(none, none, none, c)) == [
        "structured_output_rejected", "request_parameter_rejected", "authentication_or_permission_rejected", "rate_limited",
        "model_unavailable", "other", "other"]
    assert values(["Rate_Limit_Error"], lambda c: classify.upstream_error_class(c, none, none, none)) == ["rate_limited"]
    bodies = ['{"error": {"code": "Invalid_Value", "message": "x", "failed_generation": "[1, NaN]"}}', '{"error": {"type": "odd", "failed_generation": null}}',
              '{"error": []}', "[1]", "no", None, '{"error": {}}']
    told = values(bodies, classify.upstream_error)
    assert tuple(told[0]) == ("other", "invalid_value", "other", "request_parameter_rejected", "other", True, 8, "invalid")
    assert tuple(told[1])[5:] == (True, None, "not_string") and told[2:6] == [None] * 4
    assert tuple(told[6])[3:] == ("other", None, False, None, "absent")


def test_vectors(values):
    cases = [[1.0, 2.0], [], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], None]
    assert values(cases, lambda c: vectors.is_valid_vector(c, 2), "array<double>") == [True, False, False, False, False, False]
    assert values([[3.0, 4.0]], vectors.l2_normalize, "array<double>") == [[0.6, 0.8]]
    assert values([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]], lambda c: vectors.masked_mean(c, F.array(F.lit(1), F.lit(1), F.lit(0))),
                  "array<array<double>>") == [[2.0, 3.0]]


def test_json_control_characters_as_python_writes_them(values):
    texts = ["a\x1fb\x0b", "\\u001F", "\\\x1f\x1f\n\x0c", "plain", 'q"\x7f\x01']
    assert values(texts, ids.json_string) == [json.dumps(t, ensure_ascii=False) for t in texts]
