"""Public licence texts in full; the short ones without their copyright lines, the long ones in `known_texts`."""

from __future__ import annotations

import re
from functools import cache
from importlib.resources import files

TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
""",
    "0BSD": """BSD Zero Clause License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
""",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
   that you wrote the original software. If you use this software in a product,
   an acknowledgment in the product documentation would be appreciated but is
   not required.

2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>
""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
}

#: Other titles of a text; its own first line is one, too, unless it is a sentence of the licence.
TITLES = {
    "MIT": ("", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT", "License"),
    "ISC": ("", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "License"),
    "0BSD": ("", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD / Free Public License 1.0.0 (0BSD)"),
    "Zlib": ("", "The zlib License", "zlib/libpng license", "The zlib/libpng License"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "License", "The BSD License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "BSD License", "License", "The BSD License", "The BSD 3-Clause License", "Modified BSD License"),
    "BSD-4-Clause": ("", "BSD 4-Clause License", "The 4-Clause BSD License", "BSD License", "Original BSD License"),
}
_ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
   This product includes software developed by the organization.

4. Neither"""
_AUTHOR = "3. The name of the author may not be used to endorse or promote products"
_WRITE = re.compile(r"if\s+not,\s+write\s+to\s+the\s+Free\s+Software\s+Foundation,\s+Inc\.,\s+51[^.]*USA")
_END = re.compile(r"END OF TERMS AND CONDITIONS|(?=ADDENDUM: How to use|Exhibit A - Source|EXHIBIT A -Mozilla)")


@cache
def long_texts() -> dict[str, str]:
    """The texts of `known_texts` by their ids, and the BSD texts of two and four clauses."""
    texts = {p.name[:-4]: p.read_text("utf-8") for p in files("tidepool.llm").joinpath("known_texts").iterdir() if p.name.endswith(".txt")}
    bsd = texts["BSD-3-Clause"]
    texts["BSD-2-Clause"] = re.sub(r"3\. Neither.*?permission\.\n", "", bsd, flags=re.DOTALL)
    texts["BSD-4-Clause"] = bsd.replace("3. Neither", _ADVERTISING)
    return dict(sorted(texts.items()))


def variants() -> list[tuple[str, str]]:
    """(license_id, text) of every known text, with its other titles, and with and without what follows its terms."""
    out = []
    for name, text in {**TEXTS, **long_texts()}.items():
        own = [text]
        if name in TITLES:
            body = text if name.startswith("BSD") else text.split("\n", 1)[1]
            own += [f"{title}\n\n{body}" for title in TITLES[name]]
        if _WRITE.search(text):
            own.append(_WRITE.sub("if not, see <https://www.gnu.org/licenses/>", text))
        if name == "BSD-3-Clause":
            own += [re.sub(r"3\. Neither.*?products", _AUTHOR, t, flags=re.DOTALL) for t in own]
        if name == "Apache-2.0":
            own.append(text.replace("apache.org/licenses/", "apache.org/licenses/LICENSE-2.0", 1))
        if name == "GPL-2.0":
            own += [t.replace("GNU Lesser General\nPublic License instead", "GNU Library General\nPublic License instead") for t in own]
        if _END.search(text):
            own += [t[:k] for t in own for end in [_END.search(t)] for k in end.span()]
        out += [(name, t) for t in dict.fromkeys(own)]
    return out
