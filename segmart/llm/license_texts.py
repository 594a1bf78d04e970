"""Public licence notices, the part that a text has to carry, as templates for the scan."""

_GNU_NOTICE = """This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU
{kind} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any
later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."""
_GNU_COPY = " You should have received a copy of the GNU {kind} along with this {work}"
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_WRITE = """; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301
USA."""


def _gnu(work: str, kind: str, version: str, end: str = "") -> str:
    old = version.startswith("2")
    text = _GNU_NOTICE + (_GNU_COPY + end if end else "")
    return text.format(
        work=work, kind=kind, version=version, mark=";" if old else ":", comma=";" if old else ","
    )


_GPL, _LESSER, _AFFERO = (f"{x}General Public License" for x in ("", "Lesser ", "Affero "))

TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "GPL-3.0-or-later with copy": _gnu("program", _GPL, "3", _SEE),
    "GPL-2.0-or-later": _gnu("program", _GPL, "2"),
    "GPL-2.0-or-later with copy": _gnu("program", _GPL, "2", _SEE),
    "GPL-2.0-or-later with address": _gnu("program", _GPL, "2", _WRITE),
    "LGPL-2.1-or-later": _gnu("library", _LESSER, "2.1"),
    "LGPL-2.1-or-later with copy": _gnu("library", _LESSER, "2.1", _SEE),
    "LGPL-2.1-or-later with address": _gnu("library", _LESSER, "2.1", _WRITE),
    "LGPL-3.0-or-later": _gnu("program", _LESSER, "3"),
    "LGPL-3.0-or-later with copy": _gnu("program", _LESSER, "3", _SEE),
    "AGPL-3.0-or-later": _gnu("program", _AFFERO, "3"),
    "AGPL-3.0-or-later with copy": _gnu("program", _AFFERO, "3", _SEE),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "MIT statement": "Released under the MIT License.",
    "MIT licensed statement": "Licensed under the MIT License.",
    "BSD-3-Clause statement": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 statement": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 statement": "Licensed under the Mozilla Public License, version 2.0.",
    "CC-BY-4.0 statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0 statement": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 statement": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0 statement": "Released into the public domain under CC0 1.0.",
    "All rights reserved": "All rights reserved.",
}

# How statements name licences, as patterns.
_VERSION = r",?(?: ?licen[cs]e)?,?[- ]?(?:version |ver\.? |v\.? ?)?"
_LATER = r"(?:,? (?:or \(at your option\) any later version|or (?:any )?later(?: version)?)|\+)"
_NOT_LATER = rf"(?!{_LATER}|-or-later)"
NAMES: dict[str, str] = {
    "MIT": r"MIT\b",
    "ISC": r"ISC\b",
    "BSD-2-Clause": r"(?:BSD[- ]2[- ]Clause|2[- ]Clause BSD|Simplified BSD)\b",
    "BSD-3-Clause": r"(?:BSD[- ]3[- ]Clause|3[- ]Clause BSD|New BSD|Revised BSD)\b",
    "Apache-2.0": rf"Apache(?: Software)?[- ]?{_VERSION}2(?:\.0)?",
    "MPL-2.0": rf"(?:Mozilla Public|MPL)[- ]?{_VERSION}2(?:\.0)?",
    "Unlicense": r"Unlicense\b",
    "CC0-1.0": r"CC0(?:[- ]1\.0)?",
}
NAMES |= {
    f"{name}-{version}{kind}": rf"(?:GNU )?(?:{spelled} General Public|{name})[- ]?{_VERSION}{digits}{tail}"
    for name, spelled in (("LGPL", "Lesser"), ("AGPL", "Affero"))
    for version, digits in (("2.1", r"2\.1"), ("3.0", r"3(?:\.0)?"))
    for kind, tail in (("-or-later", _LATER), ("", _NOT_LATER))
}
NAMES |= {
    f"GPL-{version}{kind}": rf"(?:GNU )?(?:General Public|GPL)[- ]?{_VERSION}{digits}{tail}"
    for version, digits in (("2.0", r"2(?:\.0)?(?!\.1)"), ("3.0", r"3(?:\.0)?"))
    for kind, tail in (("-or-later", _LATER), ("", _NOT_LATER))
}
NAMES |= {
    f"CC-BY{use}-4.0": rf"(?:CC|Creative Commons)[- ]BY{use.replace('-', '[- ]')}[- ]?4\.0" for use in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND")
}
