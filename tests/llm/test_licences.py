import pytest

from oracle_check import compare, connect
from panelweave.llm import licences
from panelweave.llm.queries import ORACLES, QUERIES


def found(spark, docs):
    return {(r.doc_id, r.line, r.license_id) for r in licences.scan_licences(docs, licences.catalogue(spark)).collect()}


def test_equivalent_forms(spark, documents):
    mit = dict(licences.CATALOGUE[::-1])["MIT"]
    texts = [
        licences._MIT,
        "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + licences._MIT.upper().replace(",", " ,\n"),
        "* Copyright © 1999-2003 Them\n" + licences._MIT.replace("sublicense", "sub-license"),
        licences._MIT.replace("merge, ", ""),
        "words\nreleased under the MIT licence\nmore words",
        "words released under the MIT License.",
        "Copyright 2021 Us\n" + licences._APACHE_HEADER.replace("http:", "https:"),
    ]
    want = {(0, 0, "MIT"), (1, 0, "MIT"), (2, 0, "MIT"), (4, 2, "MIT"), (6, 0, "Apache-2.0")}
    assert found(spark, documents(list(enumerate(texts)))) == want and mit


@pytest.mark.parametrize("key,text", licences.CATALOGUE)
def test_no_text_loses_words_to_the_copyright_rule(key, text):
    import re

    assert not re.search("(?m)" + licences.COPYRIGHT_LINE, text.lower())
    assert "\n" in text or re.search(licences.SPEAKS_OF_LICENCE, text)


def test_query(spark):
    con = connect("/root/testdata/sf0.01")
    ok, said = compare(spark, con, QUERIES["op1_license_scan"], ORACLES["op1_license_scan"], "/root/testdata/sf0.01")
    assert ok, said


def test_odd_rows(spark, odd_documents, no_documents, clashing):
    assert found(spark, odd_documents) == set() and found(spark, no_documents) == set() and found(spark, clashing) == set()
