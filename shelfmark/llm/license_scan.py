"""Licence scans by canonical digests of entire texts, native throughout.

A text is normalised (ASCII letters lower-cased; lines of copyright notices dropped, and above the first other
line also up to 40 licence titles and copyright lines without a year; punctuation taken as white space,
equivalent spellings made one, white space made single), and the SHA-256 of the result is joined by hash to the
digests of known licence texts, normalised by the same expression. The known set is LICENSES (short texts,
normalised when a scan starts) and DIGESTS (longer texts, of which the digests are kept); more are a parameter.

Edge cases. A null text has no digest and no licence; an empty one, or one of notices alone, has the digest of
the empty string, which is no licence; each row gives a row, repeated ones too; ids may be null and of any type; an
empty table gives none; other columns are ignored; whole texts are read whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column

#: Short licence texts as their stewards publish them.
LICENSES = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
#: SHA-256 of the canonical form of longer licences, whole, as their stewards publish them.
DIGESTS = {
    "Apache-2.0": "86b04a6e5baf211a30858c182d594e28d3b084e9bd2a4bafa3464a6a1518ef6e",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "16018093d4eae05ac163ded9a99e3cee0c34973aff5e3ed77adfc4da5f190986",
    "GFDL-1.3": "24483827fdcab070dc64c6a0befe6fe64bdb823b040af911820bc5b81121dfe3",
    "GPL-1.0": "9132a605811c9f9a51621da0e0708f46e408e3507a3c1a9d16a5f48291082b8c",
    "GPL-2.0": "29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f",
    "GPL-3.0": "25c090443e3540e3493172ea88c9181108effea290e12e68da7dcd1c51b4cd7a",
    "LGPL-2.0": "f17ebefdba4ae01060494f3396c1bc854578b6eaafaa6fe8abcf7a94e7fc2a6e",
    "LGPL-2.1": "50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4",
    "LGPL-3.0": "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765",
    "MPL-1.1": "64a49d83bd8fd7a03e3441cca62f1c189748f458c0dcc541f24fe62524b4d833",
    "MPL-2.0": "e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2",
}
#: Spellings that mean the same, after punctuation is gone; written as whole words.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("favour", "favor"), ("organisation", "organization"), ("whilst", "while"), ("copyright owner", "copyright holder"))
_MARK = r"[ \t]*([#/*;!-]+[ \t]*)?"
#: A line that holds a dated copyright notice, or the reservation of all rights, and nothing else.
NOTICE = rf"^{_MARK}((copyright[ \t]+([(]c[)]|©|[0-9])|[(]c[)]|©)[^\n]*|all rights reserved[.]?[ \t]*)$"
#: Lines above the text: blank, a title, or any copyright line. A title is up to eight words with "license" at the end or before a version or a name in brackets.
_TITLE = r"""([a-z0-9."'+&-]+[ \t]+){0,8}licen[sc]e([ \t]*,?[ \t]*(version|v)?[ \t]*[0-9][0-9.]*)?([ \t]*[(][^()\n]*[)])?[ \t]*[:.]?"""
HEAD = rf"^\n?({_MARK}({_TITLE}|copyright[ \t][^\n]*|all rights reserved[.]?)?[ \t]*\n){{0,40}}"
#: Blank lines and white space around line ends; gone before HEAD, which so meets at most one line end in a row.
_ENDS = r"[ \t]*\n[ \t\n]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def normalized(text: Column) -> Column:
    text = F.translate(text, UPPER, LOWER)
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "(?md)" + NOTICE, "")
    text = F.regexp_replace(F.regexp_replace(text, _ENDS, "\n"), "(?d)" + HEAD, "")
    # two spaces between words, so that a spelling is found however often it stands in a row
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _OTHER, "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def known(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of the known texts, one row a text; given ones in place of the library's own."""
    rows = spark.createDataFrame(sorted((LICENSES if licenses is None else licenses).items()), "license_id string, text string")
    rows = rows.select("license_id", F.sha2(normalized(F.col("text")).cast("binary"), 256).alias("digest"))
    return rows.unionByName(spark.createDataFrame(sorted(DIGESTS.items()), rows.schema)) if licenses is None else rows


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words of the normalised text, digest, license_id or null, is_license)."""
    text = docs.select(column(id_col).alias("_id"), normalized(column(text_col)).alias("_n"))
    digests = text.select("_id", F.when(F.coalesce("_n", F.lit("")) == "", 0).otherwise(F.length("_n") - F.length(F.replace("_n", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"), F.sha2(F.col("_n").cast("binary"), 256).alias("digest"))
    found = digests.join(F.broadcast(known(docs.sparkSession, licenses)), "digest", "left")  # a few dozen rows
    return found.select(F.col("_id").alias(id_col), "n_words", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def scan_sql(licenses: dict[str, str] | None = None) -> str:
    """DuckDB SQL for scan() over documents."""
    quote = lambda x: x.replace("'", "''")

    def text_sql(text: str) -> str:
        out = f"regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '\\r\\n?', chr(10), 'g'), '(?m){NOTICE}', '', 'g')"
        out = f"regexp_replace(regexp_replace({out}, '{_ENDS}', chr(10), 'g'), '{quote(HEAD)}', '')"
        out = f"' ' || trim(regexp_replace({out}, '{_OTHER}', '  ', 'g')) || ' '"
        for a, b in SPELLINGS:
            out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(replace({out}, '  ', ' '))"

    values = ", ".join(f"('{k}', '{quote(v)}')" for k, v in sorted((LICENSES if licenses is None else licenses).items()))
    kept = "".join(f" union all select '{k}', '{v}'" for k, v in sorted(DIGESTS.items())) if licenses is None else ""
    return f"""with known as (select id license_id, sha256({text_sql('body')}) digest from (values {values}) v(id, body){kept}),
n as (select doc_id, {text_sql('text')} t from documents)
select doc_id, case when coalesce(t, '') = '' then 0 else length(t) - length(replace(t, ' ', '')) + 1 end::bigint n_words,
sha256(t) digest, license_id, license_id is not null is_license from n left join known on sha256(t) = digest"""
