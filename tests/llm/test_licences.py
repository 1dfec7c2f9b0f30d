"""Standard notices, the longer ones shortened by whole sentences, through licences()."""

import pytest

from tradeweave.llm import licences


def scan(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(licences.licences(rows).collect(), key=lambda r: r["doc_id"])]


GPL = """This program is free software{a} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """Copyright 2020 A. Nonymous

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """Copyright (c) 2020 A. Nonymous

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
"""
BSD3 = (
    BSD2
    + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
)
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
#: notice -> (identifiers it must give, licence it must give)
NOTICES = {
    "SPDX-License-Identifier: MIT": ({"spdx_mit"}, "MIT"),
    "SPDX-License-Identifier: Apache-2.0": ({"spdx_apache2"}, "Apache-2.0"),
    "SPDX-License-Identifier: GPL-2.0-only": ({"spdx_gpl2"}, "GPL-2.0"),
    "SPDX-License-Identifier: GPL-3.0-only": ({"spdx_gpl3"}, "GPL-3.0"),
    "SPDX-License-Identifier: BSD-3-Clause": ({"spdx_bsd3"}, "BSD-3-Clause"),
    "SPDX-License-Identifier: BSD-2-Clause": ({"spdx_bsd2"}, "BSD-2-Clause"),
    "SPDX-License-Identifier: MPL-2.0": ({"spdx_mpl2"}, "MPL-2.0"),
    "SPDX-License-Identifier: ISC": ({"spdx_isc"}, "ISC"),
    "Released under the MIT License.": ({"by_mit"}, "MIT"),
    APACHE: ({"by_apache2", "apache_not", "apache_copy", "apache_unless", "apache_see", "copyright"}, "Apache-2.0"),
    MPL: ({"by_mpl2"}, "MPL-2.0"),
    MIT: ({"mit_grant", "mit_notice", "as_is", "no_liability", "copyright"}, "MIT"),
    ISC: ({"isc_grant", "as_is"}, "ISC"),
    BSD2: ({"bsd_grant", "bsd_source", "bsd_binary"}, "BSD-2-Clause"),
    BSD3: ({"bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"}, "BSD-3-Clause"),
    "This is free and unencumbered software released into the public domain.": ({"unlicense"}, "Unlicense"),
    CC.format(""): ({"by_cc_by"}, "CC-BY"),
    CC.format("-ShareAlike"): ({"by_cc_by_sa"}, "CC-BY-SA"),
    CC.format("-NoDerivatives"): ({"by_cc_by_nd"}, "CC-BY-ND"),
    CC.format("-NonCommercial"): ({"by_cc_by_nc"}, "CC-BY-NC"),
    CC.format("-NonCommercial-ShareAlike"): ({"by_cc_by_nc_sa"}, "CC-BY-NC-SA"),
    CC.format("-NonCommercial-NoDerivatives"): ({"by_cc_by_nc_nd"}, "CC-BY-NC-ND"),
    "CC0 1.0 Universal Public Domain Dedication": ({"by_cc0"}, "CC0-1.0"),
    GPL.format(a=":", b=",", kind="Affero ", v=3): ({"by_agpl3", "gpl_received"}, "AGPL-3.0"),
    GPL.format(a=";", b=";", kind="Lesser ", v=2.1): ({"by_lgpl", "gpl_received"}, "LGPL"),
}
GPL2 = GPL.format(a=";", b=";", kind="", v=2)
GPL3 = GPL.format(a=":", b=",", kind="", v=3)


@pytest.mark.parametrize("sign", ["", "// "])
def test_standard_notices(spark, sign):
    texts = ["\n".join(sign + line for line in t.split("\n")) for t in NOTICES]
    got = scan(spark, texts)
    wrong = [
        (t[:60], r["licences"], r["sequence"])
        for t, r, (ids, licence) in zip(NOTICES, got, NOTICES.values(), strict=True)
        if r["licences"] != [licence] or not ids <= set(r["sequence"])
    ]
    assert not wrong, (len(wrong), wrong)


def test_gpl2_notice_is_not_cut_at_its_semicolon(spark):
    (r,) = scan(spark, [GPL2])
    assert {"by_gpl2", "gpl_received"} <= set(r["sequence"])


def test_a_sentence_gives_all_its_licences(spark):
    texts = {
        GPL3: ["GPL-3.0-or-later"],
        GPL2: ["GPL-2.0-or-later"],
        "Licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Released under the MIT license and licensed under the Apache License, Version 2.0": ["MIT", "Apache-2.0"],
        "Licensed under the MIT License or the Apache License, Version 2.0, at your option.": ["MIT", "Apache-2.0"],
        "Licensed under either of Apache License, Version 2.0 (LICENSE-APACHE) or MIT license": ["MIT", "Apache-2.0"],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
        "SPDX-License-Identifier: (BSD-3-Clause AND GPL-2.0-only)": ["GPL-2.0", "BSD-3-Clause"],
        "Licensed under CC-BY-NC-SA": ["CC-BY-NC-SA"],
        "The license is CC BY-SA 4.0 for texts and CC BY 4.0 for pictures": ["CC-BY-SA", "CC-BY"],
    }
    got = scan(spark, texts)
    assert [r["licences"] for r in got] == list(texts.values())
    assert [r["n_sentences"] for r in got[2:]] == [1] * 8
    # in the order in which they stand
    (r,) = scan(spark, ["This permission notice and that the above copyright notice and this permission notice shall be included, "
                        "and permission is hereby granted, free of charge, to any person obtaining a copy"])
    assert r["sequence"] == ["mit_notice", "mit_grant"] and r["licences"] == []


#: One example of every pattern, without other words of licensing where it can do without.
EXAMPLES = {
    "spdx_mit": "SPDX-License-Identifier: MIT",
    "spdx_mit0": "SPDX-License-Identifier: MIT-0",
    "spdx_apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx_gpl2": "SPDX-License-Identifier: GPL-2.0",
    "spdx_gpl2_later": "SPDX-License-Identifier: GPL-2.0+",
    "spdx_gpl3": "SPDX-License-Identifier: GPL-3.0",
    "spdx_gpl3_later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx_agpl3": "SPDX-License-Identifier: AGPL-3.0-only",
    "spdx_lgpl": "SPDX-License-Identifier: LGPL-2.1",
    "spdx_bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx_bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx_mpl2": "SPDX-License-Identifier: MPL-2.0",
    "spdx_isc": "SPDX-License-Identifier: ISC",
    "spdx_unlicense": "SPDX-License-Identifier: Unlicense",
    "spdx_cc0": "License: CC0-1.0",
    "spdx_bsl1": "SPDX-License-Identifier: BSL-1.0",
    "spdx_epl2": "SPDX-License-Identifier: EPL-2.0",
    "title_apache2": "Apache License Version 2.0, January 2004",
    "title_gpl2": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "title_gpl3": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "title_agpl3": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "title_lgpl": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "title_mpl2": "Mozilla Public License Version 2.0",
    "title_bsl1": "Boost Software License - Version 1.0",
    "title_epl2": "Eclipse Public License - v 2.0",
    "by_mit": "available under the Expat licence",
    "by_apache2": "licensed under the Apache License 2.0",
    "apache_not": "you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at",
    "apache_unless": "Unless required by applicable law or agreed to in writing",
    "apache_see": "See the License for the specific language governing permissions",
    "by_gpl3": "under the GNU General Public License version 3",
    "by_gpl2": "under the GNU General Public License version 2",
    "by_agpl3": "under the GNU Affero General Public License",
    "by_lgpl": "under the GNU Lesser General Public License",
    "gpl_later": "or (at your option) any later version",
    "gpl_hope": "in the hope that it will be useful, but without any warranty",
    "gpl_received": "You should have received a copy of the GNU General Public License",
    "by_mpl2": "subject to the terms of the Mozilla Public License, v. 2.0",
    "by_cc_by_nc_sa": "CC BY-NC-SA 4.0",
    "by_cc_by_nc_nd": "cc-by-nc-nd",
    "by_cc_by_nc": "cc-by-nc",
    "by_cc_by_sa": "CC BY-SA 4.0",
    "by_cc_by_nd": "CC BY-ND",
    "by_cc_by": "CC BY 4.0",
    "by_cc0": "CC0",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit_notice": "The above copyright notice and this permission notice shall be included",
    "isc_grant": "Permission to use, copy, modify, and distribute this software",
    "as_is": "The work is provided as is",
    "no_liability": "In no event shall the regents pay",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd_source": "Redistributions of source code must retain the above copyright notice",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd_endorse": "The names of others may not be used to endorse or promote products",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "all_rights": "All rights reserved.",
    "copyright": "Copyright (c) me",
}


def test_every_pattern_gets_past_the_filters(spark):
    assert list(EXAMPLES) == [name for name, _ in licences.SENTENCES]
    # as they are, and with every word on a commented line of its own
    texts = [*EXAMPLES.values(), *("// " + t.replace(" ", "\n// ") for t in EXAMPLES.values())]
    lost = [(n, r["sequence"]) for n, r in zip([*EXAMPLES] * 2, scan(spark, texts), strict=True) if n not in r["sequence"]]
    assert not lost, (len(lost), lost)
    assert [r["sequence"] for r in scan(spark, ["a public event, later", "", None])] == [[], [], []]


def test_tags_are_taken_as_they_stand(spark):
    tags = {
        "GPL-3.0-or-later": ["GPL-3.0-or-later"], "GPL-2.0+": ["GPL-2.0-or-later"], "MIT-0": ["MIT-0"],
        "AGPL-3.0-only": ["AGPL-3.0"], "LGPL-2.1": ["LGPL"], "Unlicense": ["Unlicense"], "GPL-2.0-only.": ["GPL-2.0"],
        "(MIT OR (Apache-2.0 AND GPL-3.0+))": ["MIT", "Apache-2.0", "GPL-3.0-or-later"],
        "MITNFA": [], "GPL-2.0-with-classpath": [], "Apache-2.0.1": [],
    }
    got = scan(spark, [f"# SPDX-License-Identifier: {t}" for t in tags])
    assert [r["licences"] for r in got] == list(tags.values())
    headings = scan(spark, ["License: BSD-3-Clause", "Licence: MIT, see below", "The license: whatever"])
    assert [r["licences"] for r in headings] == [["BSD-3-Clause"], ["MIT"], []]


def test_a_later_clause_belongs_to_its_notice(spark):
    texts = {
        "Under the GNU General Public License, version 3 only. Part two: under the GNU General Public License, version 2, or any later version.": ["GPL-3.0", "GPL-2.0-or-later"],
        f"{GPL3}\n\nThe tools are licensed under the GNU General Public License, version 3.": ["GPL-3.0-or-later", "GPL-3.0"],
        f"{BSD2}\n{BSD3}": ["BSD-3-Clause", "BSD-2-Clause"],
        f"{BSD3}\n{MIT}": ["MIT", "BSD-3-Clause"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy. Released under the MIT License. "
        "The above copyright notice and this permission notice shall be included.": ["MIT"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy. SPDX-License-Identifier: ISC\n\n"
        "The above copyright notice and this permission notice shall be included.": ["ISC"],
    }
    assert [r["licences"] for r in scan(spark, texts)] == list(texts.values())


def test_denied_licences_are_not_reported(spark):
    texts = [
        "This is not licensed under the MIT license.",
        "The code isn't released under the MIT license",
        "It is no longer licensed under the Apache License, Version 2.0",
        "Not distributed under the terms of the GNU General Public License, version 2",
    ]
    for r in scan(spark, texts):
        assert r["licences"] == [] and r["n_sentences"] == 1


def test_titles_of_whole_texts(spark):
    texts = {
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007": ["GPL-3.0"],
        "Boost Software License - Version 1.0 - August 17th, 2003": ["BSL-1.0"],
        "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM": ["EPL-2.0"],
        "Apache License\nVersion 2.0, January 2004": ["Apache-2.0"],
    }
    assert [r["licences"] for r in scan(spark, texts)] == list(texts.values())


def plain(text):
    """Sequence and licences by Python's own means, rules walked identifier by identifier."""
    import regex

    lower = regex.sub(licences.COMMENT, "", (text or "").replace("\r\n", "\n").replace("\r", "\n"), flags=regex.V0).lower()
    if not regex.search(licences.MAY_SPEAK, (text or "").lower()):
        return [], []
    flat = regex.sub(r"[ \t\n\x0b\f\r]+", " ", regex.sub(licences.STOP, lambda m: (m[1] or "") + licences.BREAK, lower))
    sequence = []
    for s in flat.split(licences.BREAK):
        if regex.search(licences.SPEAKS, s):
            met = [(m.start(), i, name) for i, (name, p) in enumerate(licences.SENTENCES) if (m := regex.search(p, s))]
            sequence += [name for _, _, name in sorted(met)] or [licences.UNKNOWN]
    notices, found = [], {}
    for name in sequence:
        if name.startswith(licences.BEGINS) or not notices:
            notices.append([])
        notices[-1].append(name)
    for licence, ids, without in licences.RULES:
        for n in notices:
            rest, ok = list(n), True
            for i in ids:
                ok = ok and i in rest
                rest = rest[rest.index(i) + 1 :] if ok else rest
            if ok and without not in rest:
                found[licence] = True
    return sequence, list(found)


def test_documents_equal_plain_python(spark):
    from tests.conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["sequence"], r["licences"]) for r in licences.licences(docs).collect()}
    assert got == {i: plain(t) for i, t in texts.items()} and any(found for _, found in got.values())
    for t in [*NOTICES, GPL2, GPL3, *EXAMPLES.values()]:
        (r,) = scan(spark, [t])[:1] if t in (GPL2, GPL3) else [None]
        assert r is None or (r["sequence"], r["licences"]) == plain(t)
