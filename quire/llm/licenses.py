"""License scans by MinHash over overlapping windows, in DataFrame functions only.

Texts become lower-case words and hashed shingles of five words. Long templates
are met by windows of 16 words taken every 8 words of a text and at every word of
the template, so a passage of 23 template words or more always holds a window
equal to one of the template's; each window has ``BANDS`` MinHash values, bands of
one row each, and a window of similarity s collides with probability
1 - (1 - s)**BANDS (1 for a verbatim window, 0.98 at one half). Templates
shorter than that are met by windows of five words at every word, whose MinHash is
their one shingle's hash. Retrieved templates are then verified by exact shingle
containment in the whole text.

Templates are a table: ``TEMPLATES`` has short notices, the headers of long licenses
and the whole texts (without title and holder) of seven short ones; a library of any size (whole texts of long licenses too) is passed as
rows or made by ``template_table`` from a table of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stored

SHINGLE, WINDOW, STRIDE, BANDS, CONTAINMENT = 5, 16, 8, 6, 0.9
#: Public license notices and standard paragraphs.
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "notice", "Released under the MIT License"),
    ("MIT", "notice-2", "Licensed under the MIT License"),
    ("BSD-2-Clause", "notice", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License"),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "notice", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "notice", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "notice", "Licensed under CC BY-ND 4.0"),
    ("Unlicense", "notice", "This is free and unencumbered software released into the public domain"),
    (
        "MIT",
        "permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "Apache-2.0",
        "header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "ISC",
        "permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "conditions",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "GPL-3.0",
        "header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    (
        "MIT",
        "text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        "text",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, n: int = SHINGLE) -> Column:
    def hashes(w: Column) -> Column:
        places = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(w, i, n)))

    return let(words, hashes)


def template_table(texts: DataFrame) -> DataFrame:
    """(license, part, words, shingles) of a table (license, part, text), those of at least five words; a name and part count once."""
    words = texts.select("license", "part", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    return words.withColumn("shingles", shingles_of(F.col("words"))).where(F.size("shingles") > 0).dropDuplicates(["license", "part"])


def templates(spark: SparkSession, rows=None) -> DataFrame:
    """``template_table`` of ``rows`` (license, part, text), by default ``TEMPLATES``."""
    return template_table(spark.createDataFrame(rows or TEMPLATES, "license string, part string, text string"))


def _windows(shingles: Column, step: int) -> Column:
    """(band, value) of windows of WINDOW words taken every ``step`` words, and with band -1 of all windows of one shingle."""
    wide = WINDOW - SHINGLE + 1

    def least(turned: Column, band: int) -> Column:
        places = F.when(F.size(turned) >= wide, F.sequence(F.lit(1), F.size(turned) - (wide - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.lit(band).alias("band"), F.array_min(F.slice(turned, i, wide)).alias("value")))

    def one(own: Column, band: int) -> Column:
        return let(F.transform(own, lambda s: F.xxhash64(s, F.lit(band))) if band else own, lambda turned: least(turned, band))

    single = lambda s: F.struct(F.lit(-1).alias("band"), s.alias("value"))
    return let(shingles, lambda own: F.flatten(F.array(F.transform(own, single), *(one(own, band) for band in range(BANDS)))))


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(key, license, part, n_shingles, n_found, containment) of every template held by a row of ``docs``.

    ``known`` is what ``templates`` or ``template_table`` returns; what is made of it is
    stored, so that Spark knows its size, broadcasts it under its own limit and
    shuffles beyond that. Null, empty or short texts hold nothing. Rows that repeat are
    reported once. Other columns of ``docs`` are left out, whatever their names.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), body.alias("body")).withColumn("row", F.struct(F.xxhash64("key", "body").alias("r1"), F.hash("body", "key").alias("r2")))
    hashed = rows.select("row", shingles_of(words_of(F.col("body"))).alias("shingles"))
    long = F.size("words") >= WINDOW + STRIDE - 1
    name = F.struct("license", "part").alias("name")
    marks = known.select(name, F.explode(_windows(F.col("shingles"), 1)).alias("w"), long.alias("long")).where((F.col("w.band") >= 0) == F.col("long"))
    marks = stored(marks.groupBy("w.band", "w.value").agg(F.collect_set("name").alias("names")), "marks")
    hits = hashed.select("row", F.explode(_windows(F.col("shingles"), STRIDE)).alias("w")).select("row", "w.band", "w.value").join(marks, ["band", "value"])
    found = hits.select("row", F.explode("names").alias("name")).distinct()
    theirs = stored(known.select("license", "part", F.col("shingles").alias("theirs")), "templates")
    found = found.select("row", "name.*").join(theirs, ["license", "part"])
    both = rows.join(found, "row").withColumn("n_shingles", F.size(F.array_distinct("theirs")).cast("long"))
    both = both.withColumn("n_found", F.size(F.array_intersect("theirs", shingles_of(words_of(F.col("body"))))).cast("long"))
    both = both.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 4)).where(F.col("containment") >= containment).dropDuplicates(["row", "license", "part"])
    return both.select(F.col("key").alias(key), "license", "part", "n_shingles", "n_found", "containment")
