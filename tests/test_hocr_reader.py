"""well-formed hOCR is read as XML, all else as HTML, and where both can read it they say the same."""

import pytest

from glossmill.sources import xml

PAGE = '<div class="ocr_page" title="image &quot;im/x_1.tif&quot;; bbox 0"><p id="p1"><span class="ocr_line" id="l1">{}</span></p></div>'
WORD = '<span class="ocrx_word" id="w1">{}</span> <span class="ocr_word">b</span>'
SAME = ["a", "a&amp;b &lt;c&gt; &#39;", "<b>a</b>c", "<br/>a", "é𝄞", ""]
HTML_ONLY = {"a&nbsp;b": "a\xa0b", "caf&eacute;": "café", "a<br>b": "ab", "x &copy y": "x © y", "&#150;": "–", "a\rb": "a\rb"}


def page(text: str, doctype: str = "") -> bytes:
    return f"{doctype}<html><body>{PAGE.format(WORD.format(text))}</body></html>".encode()


def said(words) -> tuple:
    return words.pages, words.doc_id, words.words


@pytest.mark.parametrize("text", SAME)
def test_xml_and_html_agree(text, monkeypatch):
    want = said(xml.hocr_words_html(page(text)))
    monkeypatch.setattr(xml, "hocr_words_html", lambda data: pytest.fail("read in Python"))
    assert said(xml.hocr_words(page(text))) == want and want[:2] == (1, "x_1")
    assert said(xml.hocr_words(page(text).replace(b"span", b"SPAN"))) == want


@pytest.mark.parametrize("doctype", ["", '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://x/y.dtd">'])
@pytest.mark.parametrize("text", HTML_ONLY)
def test_html_stays_html(text, doctype):
    found = xml.hocr_words(page(text, doctype))
    assert found.words[0][-1] == HTML_ONLY[text] and len(found.words) == 2
    assert said(found) == said(xml.hocr_words_html(page(text, doctype)))
