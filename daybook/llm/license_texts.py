"""Licence texts, notices and identifiers that the licence scan compares with.

Fixed values: the wording is the licences' own.  Notices that differ in a name or a version only are built
from one pattern.
"""

from __future__ import annotations

#: Statements that grant or name a licence in one sentence.
STATEMENTS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]

MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:"""
BSD_TWO = """Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. This notice may not be removed or
altered from any source distribution."""

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
whom the Software is furnished to do so, all subject to the following:"""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""

MOZILLA = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

ECLIPSE = """This program and the accompanying materials are made available under the terms of the Eclipse Public
License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""

CC_ZERO = """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights
to this software to the public domain worldwide. This software is distributed without any warranty. You should have
received a copy of the CC0 Public Domain Dedication along with this software."""

GNU_START = """This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}
General Public License as published by the Free Software Foundation, {choice} version {version} of the License{later}."""
GNU_REST = """This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for
more details.

You should have received a copy of the GNU {kind} General Public License along with this {thing}. If not, see
https://www.gnu.org/licenses/."""
#: (license, name in the notice, what it covers, version, date on the licence's first lines)
GNU = [
    ("GPL-2.0", "", "program", "2", "June 1991"),
    ("GPL-3.0", "", "program", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser", "library", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser", "library", "3", "29 June 2007"),
    ("AGPL-3.0", "Affero", "program", "3", "19 November 2007"),
]

#: First lines of licence files whose bodies are long.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
]

#: Identifiers that may follow SPDX-License-Identifier; those of the GNU licences come from their list.
PLAIN_IDS = [
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "MPL-2.0", "EPL-2.0",
    "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
]


def _gnu_notices() -> list[tuple[str, str]]:
    found = []
    for name, kind, thing, version, dated in GNU:
        later = ", or (at your option) any later version"
        for choice, tail in (("either", later), ("", "")):
            start = GNU_START.format(thing=thing, kind=kind, choice=choice, version=version, later=tail)
            found += [(name, start), (name, start + "\n\n" + GNU_REST.format(thing=thing, kind=kind))]
        found.append((name, f"GNU {kind} GENERAL PUBLIC LICENSE Version {version}, {dated}"))
    return found


def texts() -> list[tuple[str, str]]:
    """(license, text) of statements, notices, licence texts and first lines."""
    bsd = "\n\n".join
    return [
        *STATEMENTS,
        ("MIT", MIT_GRANT),
        ("MIT", "MIT License\n\n" + MIT_GRANT + "\n\n" + MIT_REST),
        ("BSD-2-Clause", BSD_START),
        ("BSD-2-Clause", bsd([BSD_START, BSD_TWO, BSD_END])),
        ("BSD-3-Clause", BSD_NAMES),
        ("BSD-3-Clause", bsd([BSD_START, BSD_TWO, BSD_NAMES, BSD_END])),
        ("ISC", ISC),
        ("ISC", ISC + "\n\n" + ISC_END),
        ("Zlib", ZLIB),
        ("BSL-1.0", BOOST),
        ("Apache-2.0", APACHE),
        ("MPL-2.0", MOZILLA),
        ("EPL-2.0", ECLIPSE),
        ("Unlicense", UNLICENSE),
        ("CC0-1.0", CC_ZERO),
        *_gnu_notices(),
        *TITLES,
    ]


def identifiers() -> list[tuple[str, str]]:
    """(license, identifier), with the older and the longer forms of the GNU ones."""
    gnu = [(n, n + tail) for n, *_ in GNU for tail in ("", "-only", "-or-later")]
    return [(i, i) for i in PLAIN_IDS] + gnu
