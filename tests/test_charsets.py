"""Charsets of fetched pages: marks, names, the page's own meta element, and bytes alone."""

import pytest
from pyspark.sql import functions as F

from pagequarry.sources.pages import charset_of, decoded_pages

TEXTS = {
    "gb18030": "我们提供屋顶维修和装修服务，欢迎联系我们的公司。电话和电子邮件在下面，谢谢大家的支持。",
    "big5": "我們提供屋頂維修和裝修服務，歡迎聯絡我們的公司。電話和電子郵件在下面，謝謝大家的支持。",
    "cp932": "私たちは屋根の修理とリフォームのサービスを提供しています。お気軽にお問い合わせください。",
    "euc_jp": "私たちは屋根の修理とリフォームのサービスを提供しています。お気軽にお問い合わせください。",
    "cp949": "우리는 지붕 수리와 리모델링 서비스를 제공합니다. 언제든지 문의해 주세요. 감사합니다.",
    "cp1252": "Wir decken Dächer für Häuser – größer, schöner. Grüße aus Köln!",
    "utf-8": "Dächer, крыши, 屋根",
}
LABELS = {"gb18030": "GB2312", "big5": "Big5", "cp932": "Shift_JIS", "euc_jp": "EUC-JP", "cp949": "EUC-KR", "cp1252": "iso-8859-1", "utf-8": "UTF-8"}


@pytest.mark.parametrize("charset", TEXTS)
def test_every_way_to_know_a_charset_equals_its_decoder(charset):
    page = f"<html><head><title>x</title></head><body>{TEXTS[charset]}</body></html>"
    body = page.encode(charset)
    named = page.replace("<title>", f"<!-- <meta charset=koi8-r> --><META http-equiv='Content-Type' content='text/html; charset={LABELS[charset]}'><title>")
    for given, kind in ((body, f"text/html; charset=\"{LABELS[charset]}\""), (named.encode(charset), None), (named.encode(charset), "text/html; charset=no-such"),
                        (body, "text/html")):
        assert TEXTS[charset] in given.decode(charset_of(given, kind)), kind


def test_marks_come_first_and_meta_cannot_be_utf16(spark):
    rows = [(1, "u", "text/html; charset=iso-8859-1", bytearray("\ufeffü".encode())), (2, "u", None, bytearray(b"\xff\xfe" + "ü".encode("utf-16-le"))),
            (3, "u", None, bytearray('<meta charset="utf-16">ü'.encode())), (4, "u", None, None), (5, "u", "", bytearray(b"")),
            (6, "u", "text/html; charset=utf-8", bytearray(b"a\xffb"))]
    df = spark.createDataFrame(rows, "page_id int, url string, content_type string, body binary")
    got = {r.page_id: r.html for r in decoded_pages(df.withColumn("extra", F.lit(1))).collect()}
    assert got == {1: "ü", 2: "ü", 3: '<meta charset="utf-16">ü', 4: None, 5: "", 6: "a�b"}
    assert decoded_pages(df.limit(0)).count() == 0
