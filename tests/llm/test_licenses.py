"""Notices that the license scan must find, and those it must not."""
import random

from faultlens.llm import licenses


def found(text, templates=None):
    scanner = licenses.Scanner(templates or licenses.TEMPLATES)
    have = licenses.words_of(text.encode())
    return [(scanner.names[m[0]], m[3], m[4]) for m in scanner.notices(have)] if any(s in text.lower().encode() for s in scanner.signs) else []


def test_wrapped_notices(table):
    mpl = "code\n\nThis Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy\n"
    isc = "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee\nis hereby granted.\n"
    cc0 = "Dedicated to the public \n  domain under CC0 1.0 Universal."
    got = [(r.doc_id, r.license, r.exact) for r in licenses.scan(table([(1, mpl), (2, isc), (3, cc0)])).orderBy("doc_id").collect()]
    assert got == [(1, "MPL-2.0", True), (2, "ISC", True), (3, "CC0-1.0", True)]


def test_templates_without_a_usual_sign():
    own = {"Own": "Feel free to share these pages with friends."}
    assert found("some text\nFeel free to share\nthese pages with friends. more", own) == [("Own", [], [])]


def test_stray_words_far_from_a_notice_do_not_count():
    assert found("Copyright (c) 2015-2020 The Foo Bar Authors. All rights reserved.") == [("All-Rights-Reserved", [b"copyright"], [])]
    text = "In this report we describe a tool that reads texts, and how well it does so on a work of many pages, with all of its results. The work is licensed under the GNU General Public License, version 3."
    assert found(text) == [("GPL-3.0", [b"this"], [])]


def test_every_notice_of_a_block_is_given(table):
    text = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    assert found(text) == [("MIT", [], []), ("Apache-2.0", [], [])]
    assert found("Licensed under CC BY 4.0. " * 3) == [("CC-BY-4.0", [], [])] * 3
    rows = licenses.scan(table([(1, text)])).collect()
    assert sorted(text[r.start:r.end] for r in rows) == sorted(text.split("\n"))


def test_full_texts_headers_and_tags():
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version."""
    bsd = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
    names = lambda text: [n for n, _, _ in found(text)]
    assert found(mit) == [("MIT", [], [])] and found(bsd) == [("BSD-2-Clause", [], [])]
    assert found(gpl.format(3)) == [("GPL-3.0", [], [])] and found(gpl.format(2)) == [("GPL-2.0", [], [])]
    assert names("// SPDX-License-Identifier: BSD-2-Clause\nint x;") == ["BSD-2-Clause"]
    assert names("The program is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("/* SPDX-License-Identifier: GPL-2.0-or-later */") == ["GPL-2.0"]


def test_each_wording_is_found_as_its_own_licence():
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert found(f"before it {text}\nand after") == [(name, [], [])], text


def test_a_short_notice_without_the_name_is_not_the_licence():
    assert found("Released under the ISC License.") == [] and found("SPDX-License-Identifier: Zlib") == []
    assert [n for n, _, _ in found("Released under the ISC License.\nIt is licensed under MIT License.")] == ["MIT"]


def test_changed_names_versions_and_negations_are_refused():
    bsd = "Redistribution and use in source and binary forms, with or without modification, are {}permitted provided that the following conditions are met:"
    assert [n for n, _, _ in found(bsd.format(""))] == ["BSD-3-Clause"] and found(bsd.format("not ")) == []
    for text in ("Licensed under CC BY-ND 4.0.", "This work is licensed under the GNU Free Documentation License, version 1.", "This work is licensed under the GNU General Public License, version 9.",
                 "This work is licensed under the Acme General Public License, version 3.", "All rights reserved by the hotel are void.", "It is not licensed under the MIT License.",
                 "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY 3.0."):
        assert found(text) == [], text
    assert [n for n, _, _ in found("It is not licensed under the MIT License. Released under the MIT License.")] == ["MIT"]
    assert [n for n, _, _ in found("All rights reserved.")] == ["All-Rights-Reserved"]
    assert [n for n, _, _ in found("Copyright 2020 A. Author. All rights reserved by the author.")] == ["All-Rights-Reserved"]


def test_compression_decides_between_wordings_that_both_hold(monkeypatch):
    own = {"A": "these pages may be shared with friends and family at any time", "B": "these pages may be shared with friends and family at any hour"}
    text = "these pages may be shared with friends and family at any hour"
    assert [n for n, _, _ in found(text, own)] == ["B"]
    saved = licenses.Scanner.saved
    monkeypatch.setattr(licenses.Scanner, "saved", lambda *a: -saved(*a))
    assert [n for n, _, _ in found(text, own)] == ["A"]


def test_exact_notices_against_brute_force(table):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(200)]
    short = {n: [t for t in ts if len(licenses.words_of(t.encode())) < 400] for n, ts in licenses.TEMPLATES.items()}
    texts = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(0, 9)):
            parts.append(" ".join(rng.choice(plain) for _ in range(rng.randrange(4, 60))))
            parts.append(rng.choice(rng.choice(list(short.values()))))
        texts.append((k, "\n".join(parts)))
    texts.append((100, "filler words here " + "\n".join(["Licensed under CC BY 4.0. and then"] * 300)))
    wordings = sorted(((licenses.words_of(t.encode()), n) for n, ts in short.items() for t in ts), key=lambda x: -len(x[0]))
    want = []
    for k, text in texts:
        have = licenses.words_of(text.encode())
        taken = [False] * len(have)
        for w, n in wordings:  # the longest first
            for at in range(len(have) - len(w) + 1):
                if have[at] == w[0] and have[at:at + len(w)] == w and not any(taken[at:at + len(w)]):
                    taken[at:at + len(w)] = [True] * len(w)
                    want.append((k, n, " ".join(x.decode() for x in w)))
    rows = licenses.scan(table(texts)).collect()
    source = dict(texts)
    got = [(r.doc_id, r.license, " ".join(x.decode() for x in licenses.words_of(source[r.doc_id].encode()[r.start:r.end]))) for r in rows]
    assert sorted(got) == sorted(want) and all(r.exact for r in rows)
