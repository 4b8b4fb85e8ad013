"""Licence sentences that a word filter or line ends must not lose."""

from deskline.llm import license_rules

# A sentence for every identifier.
SENTENCES = {
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-bsd-2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-gpl-3.0": "SPDX-License-Identifier: GPL-3.0",
    "spdx-gpl-2.0": "SPDX-License-Identifier: GPL-2.0",
    "spdx-mpl-2.0": "SPDX-License-Identifier: MPL-2.0",
    "spdx-other": "SPDX-License-Identifier: Zlib",
    "cc-by-nc-sa-4.0": "CC BY-NC-SA 4.0",
    "cc-by-nc-4.0": "Attribution-NonCommercial 4.0",
    "cc-by-sa-4.0": "Text is CC-BY-SA-4.0",
    "cc-by-4.0": "Creative Commons Attribution 4.0",
    "cc0": "The data is CC0",
    "apache-2-grant": "Licensed under the Apache License, Version 2.0",
    "apache-2-copy": "You may obtain a copy of the License at the address below",
    "apache-as-is": 'Software distributed under the License is distributed on an "AS IS" BASIS',
    "lgpl": "GNU Lesser General Public License",
    "agpl-3": "GNU Affero General Public License",
    "gpl-3-or-later": "GNU General Public License, either version 3 or any later version",
    "gpl-3": "GNU General Public License, version 3",
    "gpl-2-or-later": "GNU General Public License, either version 2 or any later version",
    "gpl-2": "GNU General Public License version 2",
    "gpl": "GNU General Public License",
    "mpl-2": "Mozilla Public License, version 2.0",
    "mit-name": "The MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of it",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose is granted",
    "bsd-name-3": "BSD 3-Clause",
    "bsd-name-2": "2-Clause BSD",
    "bsd-grant": "Redistribution and use in source and binary forms are permitted",
    "bsd-source": "Redistributions of source code must retain the above copyright notice",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
    "bsd-names": "Neither the name of X nor the names of others may be used to endorse products",
    "as-is": 'It is provided "as is", without warranty',
    "all-rights": "All rights reserved",
    "copyright": "Copyright (c) 2024 X",
}
LICENCES = {
    "BSD-3-Clause": "BSD 3-Clause",
    "BSD-2-Clause": "Simplified BSD License",
    "MIT": SENTENCES["mit-grant"],
    "ISC": SENTENCES["isc-grant"],
    "Apache-2.0": SENTENCES["apache-2-copy"],
    "AGPL-3.0": SENTENCES["agpl-3"],
    "LGPL": SENTENCES["lgpl"],
    "GPL-3.0-or-later": SENTENCES["gpl-3-or-later"],
    "GPL-3.0": SENTENCES["gpl-3"],
    "GPL-2.0-or-later": SENTENCES["gpl-2-or-later"],
    "GPL-2.0": SENTENCES["gpl-2"],
    "GPL": SENTENCES["gpl"],
    "MPL-2.0": SENTENCES["mpl-2"],
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Attribution-ShareAlike 4.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC0-1.0": "CC0",
    "Other": SENTENCES["spdx-other"],
    "Proprietary": "Copyright 2024 X. All rights reserved.",
}


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["n_sentences"], r["identifiers"], r["licences"]) for r in sorted(license_rules.licences(df).collect())]


def test_every_rule_has_a_sentence_that_it_finds(spark):
    assert list(SENTENCES) == [n for n, _ in license_rules.SENTENCES] and list(LICENCES) == [n for n, _ in license_rules.LICENCES]
    got = found(spark, [f"Some words before.\n{s}.\nSome words after." for s in SENTENCES.values()])
    assert [(n, i) for n, i, _ in got] == [(1, name) for name in SENTENCES]
    assert [x for _, _, x in found(spark, LICENCES.values())] == list(LICENCES)
    assert found(spark, ["All rights reserved.", "No clause of this is reserved for attribution."]) == [(1, "all-rights", "Proprietary"), (0, "", "")]


MIT = """MIT License

Copyright (c) 2024 X

Permission is hereby granted, free of charge, to any person
obtaining a copy of this software, to deal in it without
restriction, subject to the following conditions:

The above copyright notice and this
permission notice shall be included in all copies.
"""
BSD = """Copyright (c) 2024, X
All rights reserved.

Redistribution and use in source and binary
forms, with or without modification, are permitted provided that the following conditions are met:
* Redistributions of source code must retain the above
  copyright notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright
  notice in the documentation.
* Neither the name of X nor the names of its contributors
  may be used to endorse or promote products.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the notice appears in all copies.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
WARRANTY = 'The software is provided "as is",\nand comes without\nwarranty of any kind.'


def test_wrapped_texts_are_read_whole(spark):
    want = ["MIT", "BSD-3-Clause", "ISC", "GPL-3.0-or-later"]
    for mark in ("", "# ", " * ", "// ", "-- ", ";; "):
        texts = ["".join(mark + line + "\n" for line in t.splitlines()) for t in (MIT, BSD, ISC, GPL)]
        assert [x for _, _, x in found(spark, texts)] == want, mark
    assert [i for _, i, _ in found(spark, [WARRANTY, GPL.replace("\n", "\r\n")])] == ["as-is", "gpl-3-or-later"]


def test_lines_without_a_stop_keep_their_own_identifiers(spark):
    texts = [
        "SPDX-License-Identifier: MIT\nCopyright 2024 X\nAll rights reserved",
        "Licensed under CC BY-NC 4.0\nReleased under the MIT License",
        "GNU General Public License version 2 or any later version\nGNU General Public License version 3 or any later version",
        "GNU General Public License\nGNU General Public License\nversion 3 or\nany later version",
    ]
    assert [i for _, i, _ in found(spark, texts)] == ["spdx-mit,copyright,all-rights", "cc-by-nc-4.0,mit-name", "gpl-2-or-later,gpl-3-or-later", "gpl,gpl-3-or-later"]
