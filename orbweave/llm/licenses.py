"""License scans by canonical digests, in DataFrame functions only.

A text is made canonical: no copyright lines, lower case, equivalent spellings unified, punctuation (comment leaders, too)
and white space as single blanks.  The SHA-256 of the whole canonical text is hash-joined to the digests of known licence
texts, of which each is known with and without its usual titles and list numbers; the digests of its single lines are joined to
those of known licence notices in the same join.  Every known text contains a marker word, so texts and lines without one
cannot match and are not digested.  Only digests are shuffled, and only those of texts with a marker.

A copyright line is one that goes on after the word with a year, (c), a placeholder, or a name of two capital words; a line
of a licence that is wrapped before "copyright notice" stays.

Null and empty texts match nothing.  Texts that become equal have equal digests; a repeated row is repeated.  Notices are
listed once each, sorted.  An empty table gives an empty result, very long texts are digested whole, and extra columns are
ignored.  The known digests are a constant of this module and broadcast.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns and word pairs.
COPYRIGHT = (
    r"(?m)^[ \t#*/;%!<>|-]*(?:(?i:portions[ \t]+)?(?i:copyright)[ \t,:]*(?:(?i:\(c\)|©|by[ \t])|[\[<{]|[0-9]{4}|(?:The[ \t]+)?[A-Z][a-z][A-Za-z.'-]*[ \t]+[A-Z])"
    r"|©|(?i:\(c\)[ \t]*(?:copyright|[0-9]{4}))|(?i:all rights reserved)[.\t\r ]*$)[^\n]*$"
)
MARKER = r"(?i)licen[cs]|permission|redistribut|warrant|public domain"
SPELLINGS = (("licenc", "licens"), (r"\bsub license\b", "sublicense"), (r"\bnon commercial\b", "noncommercial"), (r"\bwhilst\b", "while"), (r"\bfavour", "favor"), (r"\bcopyright holder", "copyright owner"), (r"\banalogue\b", "analog"), (r"\bartefact", "artifact"), (r"\bfulfil\b", "fulfill"), (r"\bjudgement", "judgment"), (r"\borganisation", "organization"), (r"\backnowledgement", "acknowledgment"))

#: Whole texts of public licences, which must be word for word.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
#: Fixed value: the condition that makes the two conditions three.
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("\n\nTHIS SOFTWARE", f"\n\n{THIRD}\n\nTHIS SOFTWARE")
#: Titles that stand above the texts, or don't.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License", "Zero Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Digests of the canonical forms of long licences, the whole text and the text up to the end of its terms.
DIGESTS = {
    "Apache-2.0": ("e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    "Artistic-1.0-Perl": ("64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("dc0a69dd77c36ecefaab939fe6f1fe20d430b27b4bba90820623760aadc9d0be",),
    "GFDL-1.3": ("f63115b17c1c179670bd2984927f637d14545c9ad5ef5b33ab30f5073f67a635",),
    "GPL-1.0": ("37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9"),
    "GPL-2.0": ("ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0"),
    "GPL-3.0": ("42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1", "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b"),
    "LGPL-2.0": ("bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e", "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389"),
    "LGPL-2.1": ("ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",),
}
#: The usual notices of one line.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Apache License, Version 2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
    "GPL-3.0": ("Licensed under the GNU General Public License, version 3.", *(f"This {what} is licensed under the GNU General Public License, version 3." for what in ("file", "program", "software", "work"))),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
}


def canonical_text(text: str) -> str:
    """The canonical form, for the known texts."""
    text = re.sub(r"[^a-z0-9]+", " ", re.sub(COPYRIGHT, " ", text).lower()).strip()
    for other, one in SPELLINGS:
        text = re.sub(other, one, text)
    return text


def canonical(text: Column) -> Column:
    """The same form as an expression; (?d) lets lines end at \\n alone, as elsewhere."""
    out = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "(?d)" + COPYRIGHT, " ")), r"[^a-z0-9]+", " "))
    for other, one in SPELLINGS:
        out = F.regexp_replace(out, other, one)
    return out


def digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def known() -> dict[tuple[str, bool], str]:
    """(digest, whether of a whole text) to licence."""
    out: dict[tuple[str, bool], str] = {}

    def put(text: str, whole: bool, name: str) -> None:
        if not re.search(MARKER, text):
            raise ValueError(f"a known text has no marker word: {text[:60]}")
        out[digest(text), whole] = name

    for name, text in TEXTS.items():
        for title in ("", *TITLES[name]):
            for body in (text, re.sub(r"(?m)^[0-9]\. ", "", text)):
                put(f"{title}\n{body}", True, name)
    for name, digests in DIGESTS.items():
        out |= {(x, True): name for x in digests}
    for name, lines in NOTICES.items():
        for line in lines:
            put(line, False, name)
    for name in (*TEXTS, *DIGESTS, *NOTICES):
        put(f"SPDX-License-Identifier: {name}", False, name)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, license_id, notices) per row: the digest of the whole canonical text where it may be known,
    the licence whose text it is, and the licences whose notices are among its lines, joined by commas ('' if none)."""
    table = F.broadcast(docs.sparkSession.createDataFrame(sorted((*key, name) for key, name in known().items()), "digest string, whole boolean, license string"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    none = F.lit(None).cast("string")
    unmarked = rows.where(~F.col("text").rlike(MARKER)).select(F.col("id").alias(id_col), none.alias("text_sha256"), none.alias("license_id"), F.lit("").alias("notices"))
    marked = rows.where(F.col("text").rlike(MARKER)).select("id", F.xxhash64("text").alias("tid"), F.sha2(canonical(F.col("text")), 256).alias("text_sha256"), F.filter(F.split("text", "\n"), lambda x: x.rlike(MARKER)).alias("lines"))
    units = F.concat(F.array(F.struct(F.col("text_sha256").alias("digest"), F.lit(True).alias("whole"))), F.transform(F.array_distinct("lines"), lambda x: F.struct(F.sha2(canonical(x), 256).alias("digest"), F.lit(False).alias("whole"))))
    looked = marked.select("id", "tid", "text_sha256", F.explode(units).alias("u")).select("id", "tid", "text_sha256", "u.*").join(table, ["digest", "whole"], "left")
    # every row has one unit that is whole, so that their number is that of rows alike
    found = looked.groupBy("id", "tid", "text_sha256").agg(
        F.count_if("whole").alias("rows"), F.max(F.when(F.col("whole"), F.col("license"))).alias("license_id"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices")
    )
    again = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))
    return unmarked.unionByName(found.select(F.col("id").alias(id_col), "text_sha256", "license_id", "notices", again.alias("copy")).drop("copy"))


def scan_sql(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same in the SQL of DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"trim(regexp_replace(lower(regexp_replace({text}, {quote(COPYRIGHT)}, ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
        for other, one in SPELLINGS:
            out = f"regexp_replace({out}, {quote(other)}, '{one}', 'g')"
        return out

    values = ", ".join(f"('{x}', {str(whole).lower()}, '{name}')" for (x, whole), name in sorted(known().items()))
    return f"""
WITH known(digest, whole, license_id) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, {id_col}, coalesce({text_col}, '') AS t FROM {table}),
m AS (SELECT *, regexp_matches(t, '{MARKER}') AS may FROM d),
w AS (SELECT r, {id_col}, CASE WHEN may THEN sha256({form('t')}) END AS text_sha256 FROM m),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM m WHERE may),
n AS (SELECT l.r, string_agg(DISTINCT known.license_id, ',' ORDER BY known.license_id) AS notices
      FROM l JOIN known ON NOT known.whole AND regexp_matches(line, '{MARKER}') AND sha256({form('line')}) = known.digest GROUP BY l.r)
SELECT w.{id_col}, w.text_sha256, k.license_id, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN known k ON k.whole AND w.text_sha256 = k.digest LEFT JOIN n ON w.r = n.r"""
