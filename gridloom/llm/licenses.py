"""License scans by canonical digests: whole texts, normalised, hash-joined to the digests of known license texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

#: Equivalent spellings, replaced in this order as whole words of normalised text.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("non commercial", "noncommercial"), ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"), ("fulfilment", "fulfillment"), ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"), ("organisation", "organization"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("v2 0", "version 2 0"), ("v3", "version 3"), ("https", "http"),
]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'

#: Public license texts and one-line grants by SPDX id. A text is known if its canonical form is one of these.
KNOWN = [
    ("MIT", _MIT), ("MIT", "The MIT License " + _MIT), ("MIT", "MIT License " + _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", _BSD_HEAD + " " + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_HEAD + " " + _BSD_TAIL), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]


def canonical(text: F.Column) -> F.Column:
    """Lower case; without lines that begin with a copyright notice or reserve all rights; runs of anything but letters and digits as one space; equivalent spellings as one.

    A last replacement joins the first and last words to the rest, so a whole text compares by its words alone.
    """
    own = F.lower(F.coalesce(text, F.lit("")))
    own = F.regexp_replace(own, r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$", " ")
    own = F.concat(F.lit(" "), F.regexp_replace(own, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    own = F.regexp_replace(own, " +", " ")
    for old, new in SPELLINGS:
        own = F.replace(own, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(own)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license) of the known texts; of texts with one canonical form the first id holds."""
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(texts)], "k int, license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "k", "license").groupBy("digest").agg(F.min_by("license", "k").alias("license"))


def scan_licenses(docs: DataFrame, texts: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(doc_id, canonical_sha256, license) for every row of docs: the known license that its whole text is, or null.

    Null texts are empty, and an empty canonical text is no license. Repeated rows are reported each; an empty table gives none.
    Texts of any length are compared whole, and one long text may be a license only if all of it is. Other columns may have any names.
    The known table has as many rows as texts, which is what is broadcast.
    """
    known = known_digests(docs.sparkSession, texts).where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("canonical_sha256"))
    return rows.join(F.broadcast(known.withColumnRenamed("digest", "canonical_sha256")), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(c: str) -> str:
        own = rf"regexp_replace(lower(coalesce({c}, '')), '(?m)^[^\p{{L}}\p{{N}}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$', ' ', 'g')"
        own = rf"regexp_replace(' ' || regexp_replace({own}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ', ' +', ' ', 'g')"
        for old, new in SPELLINGS:
            own = f"replace({own}, ' {old} ', ' {new} ')"
        return f"sha256(trim({own}, ' '))"

    values = ", ".join(f"({k}, {quote(a)}, {quote(b)})" for k, (a, b) in enumerate(KNOWN))
    return f"""
    WITH k AS (SELECT {canon("text")} AS digest, arg_min(license, k) AS license FROM (VALUES {values}) t(k, license, text) GROUP BY 1),
    d AS (SELECT doc_id, {canon("text")} AS canonical_sha256 FROM documents)
    SELECT doc_id, canonical_sha256, license FROM d LEFT JOIN k ON digest = canonical_sha256"""


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLE = {"op7_license_scan": _sql()}
