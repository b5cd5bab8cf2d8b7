"""The licence scan on published notices, wrapped and broken ones, and against a plain matcher."""

import itertools

import pytest

from rivulant.llm.license_pack import RULES, SENTENCES
from rivulant.llm.license_scan import Scanner, license_scan, normal_words

BY_NAME = {}
for name, sentence in SENTENCES:
    BY_NAME.setdefault(name, sentence)


def names(text):
    s = Scanner()
    return [x[0] for x in s.licences(text.encode(), s.sentences(text.encode()))]


def test_every_sentence_is_known_and_every_rule_fits():
    s = Scanner()
    for name, sentence in SENTENCES:
        assert [x[0] for x in s.sentences(sentence.encode())] == [name]
        wrapped = "Intro.\n" + sentence.replace(" ", "\n   ") + "\nmore text"
        assert [x[0] for x in s.sentences(wrapped.encode())] == [name]
    for licence, wanted in RULES:
        assert names("\n".join(BY_NAME[w] for w in wanted)) == [licence]


@pytest.mark.parametrize("text, want", [
    ("x.*** y\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("Code. Released under the MIT License. More", ["MIT"]),
    ("not Released under the MIT License.", []),
    ("Released under the MIT License of old.", []),
    ("éReleased under the MIT License.", []),
    ("// Licensed under CC BY-NC 4.0.\nReleased under the MIT License", ["CC-BY-NC-4.0", "MIT"]),
    ("", []),
])
def test_places(text, want):
    assert names(text) == want


def test_sequences():
    bsd = [BY_NAME[w] for w in ("bsd-use", "bsd-source", "bsd-binary", "bsd-names")]
    assert names("\n1. ".join(bsd)) == ["BSD-3-Clause"]
    assert names("\n".join(bsd[:3])) == ["BSD-2-Clause"]
    assert names("\n".join(bsd[:2])) == []
    assert names("\n".join([*bsd[:2], *["other words."] * 9, bsd[2]])) == []
    assert names("\n".join([bsd[1], bsd[0], bsd[2]])) == []


def test_gaps_are_a_parameter():
    bsd = [BY_NAME[w] for w in ("bsd-use", "bsd-source", "bsd-binary")]
    text = "\n".join([*bsd[:2], *["other words."] * 900, bsd[2]]).encode()
    for between, want in ((None, ["BSD-2-Clause"]), (4, []), (2000, ["BSD-2-Clause"])):
        s = Scanner(between=between)
        assert [x[0] for x in s.licences(text, s.sentences(text))] == want
    wide = "\n".join([*bsd[:2], "w " * 9000, bsd[2]]).encode()  # far apart, few ends
    assert [x[0] for x in Scanner().licences(wide, Scanner().sentences(wide))] == ["BSD-2-Clause"]


@pytest.mark.parametrize("licence, words", [
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-more", "lgpl-copy")), ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-more", "agpl-copy", "gpl-else")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-more", "gpl-copy", "gpl-else")), ("MPL-2.0", ("mpl2-terms", "mpl2-copy")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-product", "zlib-altered", "zlib-notice")),
    ("0BSD", ("0bsd-grant", "isc-as-is", "isc-liable")), ("ISC", ("isc-grant", "isc-as-is", "isc-liable")), ("CC0-1.0", ("cc0-waiver", "cc0-warranty")),
])
def test_whole_notices_inside_comments(licence, words):
    notice = " ".join(BY_NAME[w] for w in words)
    lines = [notice[i : i + 60] for i in range(0, len(notice), 60)]
    wrapped = "\n".join(" * " + line.strip() for line in notice.replace(". ", ".\n * ").split("\n"))
    assert names("/*\n" + wrapped + "\n */\nint main() {}\n") == [licence] and lines


def test_spdx_lines_and_titles():
    assert names("// SPDX-License-Identifier: LGPL-3.0-or-later\n# SPDX-License-Identifier: MIT-0\n") == ["LGPL-3.0-or-later", "MIT-0"]
    assert names("MIT License\n\nCopyright (c) 2020 A B\n") == ["MIT"]
    assert names("SPDX-License-Identifier: Nonsense-1.0\n") == []


def plain(text):
    """All unit starts against all sentences, longest first."""
    lines, out = text.split("\n"), []
    known = {tuple(normal_words(s.encode())): n for n, s in SENTENCES}
    i = 0
    while i < len(lines):
        for j in range(min(len(lines), i + 6), i, -1):
            words = tuple(normal_words("\n".join(lines[i:j]).encode()))
            if words in known:
                out.append(known[words])
                i = j - 1
                break
        i += 1
    return out


def test_against_all_lines():
    parts = ["Released under the MIT License.", "Licensed under the", "Apache License, Version 2.0.", "some words", "MIT License", ""]
    s = Scanner()
    for combo in itertools.product(parts, repeat=4):
        text = "\n".join(combo)
        assert [x[0] for x in s.sentences(text.encode())] == plain(text), combo


def test_over_spark(spark):
    long = "word " * 300_000 + "\nReleased under the MIT License.\n" + "word " * 10
    rows = [(1, None, 1), (None, "", 2), (3, long, 3), (4, "Licensed under CC BY 4.0.", 4), (4, "Licensed under CC BY 4.0.", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences int")
    got = sorted((str(r.doc_id), r.n_sentences, [x.licence for x in r.licences]) for r in license_scan(df).collect())
    assert got == [("1", 0, []), ("3", 1, ["MIT"]), ("4", 1, ["CC-BY-4.0"]), ("4", 1, ["CC-BY-4.0"]), ("None", 0, [])]
    for r in license_scan(df.filter("doc_id = 3")).collect():
        assert long.encode()[r.licences[0].start : r.licences[0].end] == b"Released under the MIT License"
    assert license_scan(df.limit(0)).count() == 0
