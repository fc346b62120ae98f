"""Texts and marks of common licences for the licence scan."""

from __future__ import annotations

#: Full texts and headers as their authors publish them, without copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_APACHE_TITLE = "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
_GNU_TITLE = "GNU {name} Version {version}, {date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal (CC0 1.0) Public Domain Dedication."



def _gnu(name: str, version: str, what: str, date: str) -> list[str]:
    header = _GNU.format(what=what, name=name, version=version)
    title = _GNU_TITLE.format(name=name.upper(), version=version, date=date)
    return [header, header.split("\n")[0], title, title.split(" Copyright")[0]]


#: Licence, its names in notices, its identifiers, its longer texts.
_GENERAL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
_KNOWN = [
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], ["Apache-2.0"], [_APACHE, _APACHE.split("\n")[0], _APACHE_TITLE]),
    ("MIT", ["MIT License"], ["MIT"], [_MIT, _MIT.split("\n")[0]]),
    ("ISC", ["ISC License"], ["ISC"], [_ISC, _ISC.split("\n")[0]]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License"], ["BSD-2-Clause"], [_BSD_START + _BSD_END]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License"], ["BSD-3-Clause"], [_BSD_START + _BSD_THIRD + _BSD_END]),
    *(
        (id, [f"GNU {name}, version {version}", f"GNU {name} v{version}"], [f"{id}-only", f"{id}-or-later"], _gnu(name, version, what, date))
        for id, name, version, what, date in (
            ("GPL-2.0", _GENERAL, "2", "program", "June 1991"), ("GPL-3.0", _GENERAL, "3", "program", "29 June 2007"), ("LGPL-2.1", _LESSER, "2.1", "library", "February 1999"),
            ("LGPL-3.0", _LESSER, "3", "library", "29 June 2007"), ("AGPL-3.0", _AFFERO, "3", "program", "19 November 2007"),
        )
    ),
    ("MPL-2.0", ["Mozilla Public License, version 2.0"], ["MPL-2.0"], [_MPL, _MPL.split(". If")[0], "Mozilla Public License Version 2.0 1. Definitions"]),
    ("EPL-2.0", ["Eclipse Public License, version 2.0"], ["EPL-2.0"], ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"]),
    ("Unlicense", ["Unlicense"], ["Unlicense"], [_UNLICENSE, _UNLICENSE.split("\n")[0]]),
    ("CC0-1.0", ["CC0 1.0 Universal Public Domain Dedication", "CC0 1.0"], ["CC0-1.0"], [_CC0]),
]
_CC = {"": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _parts in ((), ("SA",), ("NC",), ("ND",), ("NC", "SA"), ("NC", "ND")):
    _id, _name = "-".join(("CC-BY", *_parts, "4.0")), "-".join([_CC[""], *(_CC[p] for p in _parts)])
    _short = "CC " + "-".join(("BY", *_parts)) + " 4.0"
    _KNOWN.append((_id, [f"Creative Commons {_name} 4.0 International License", _short], [_id], []))


def _all() -> tuple[tuple[str, str], ...]:
    out = []
    for id, names, ids, texts in _KNOWN:
        for n in names:
            out += [(id, n), (id, f"Licensed under the {n}."), (id, f"Released under the {n}."), (id, f"This work is licensed under the {n}."), (id, f"This project is licensed under the {n}. See the LICENSE file for details.")]
        out += [(id, f"SPDX-License-Identifier: {i}") for i in ids] + [(id, t) for t in texts]
    return tuple(out)


#: (licence, text).
TEMPLATES = _all()

_OTHER_GNU = "affero|agpl|lesser|lgpl|library general"
_V = lambda n: f"(version|v|gpl|gplv|license|licence) ?{n}( |$)"
_NC, _SA, _ND = "(^| )(nc|noncommercial|non commercial)( |$)", "(^| )(sa|sharealike|share alike)( |$)", "(^| )(nd|noderivatives|noderivs|no derivatives|no derivs)( |$)"
_THIRD = "3 clause|three clause|neither the name|names of its contributors|endorse or promote|new bsd|modified bsd"
#: What the words of a text, parted by single spaces, must hold and must not hold for a licence: versions and variants, which a cosine
#: hardly weighs. Patterns of both regular expression dialects.
MARKS: dict[str, tuple[str, str]] = {
    "Apache-2.0": ("apache.* 2( |$)|apache ?2", "apache.* 1 [01]( |$)"),
    "MIT": ("(^| )mit( |$)|permission is hereby granted free of charge", "(^| )mit 0( |$)|no attribution"),
    "ISC": ("(^| )isc( |$)|with or without fee", "zero clause|0bsd"),
    "BSD-2-Clause": ("2 clause|two clause|simplified bsd|freebsd|redistribution and use in source", f"{_THIRD}|all advertising materials"),
    "BSD-3-Clause": (_THIRD, "all advertising materials"),
    "GPL-2.0": (_V("2"), _OTHER_GNU),
    "GPL-3.0": (_V("3"), _OTHER_GNU),
    "LGPL-2.1": ("(lesser|lgpl).*2 1( |$)|2 1 .*(lesser|lgpl)", "affero|agpl"),
    "LGPL-3.0": (f"(lesser|lgpl).*({_V('3')}|lgpl ?v?3)|lgpl ?v?3", "affero|agpl"),
    "AGPL-3.0": ("affero|agpl", "affero general public license (version|v) ?1( |$)"),
    "MPL-2.0": ("(mozilla|mpl).* 2( |$)", "(mozilla|mpl) (public license )?(version |v )?1 [01]( |$)"),
    "EPL-2.0": ("(eclipse|epl).* 2( |$)", "(eclipse|epl) (public license )?(version |v )?1 0( |$)"),
    "Unlicense": ("unlicense|unencumbered software", "^$"),
    "CC0-1.0": ("cc0", "^$"),
    "CC-BY-4.0": ("4 0", f"{_NC}|{_SA}|{_ND}"),
    "CC-BY-SA-4.0": (f"({_SA}).*4 0", f"{_NC}|{_ND}"),
    "CC-BY-NC-4.0": (f"({_NC}).*4 0", f"{_SA}|{_ND}"),
    "CC-BY-ND-4.0": (f"({_ND}).*4 0", f"{_NC}|{_SA}"),
    "CC-BY-NC-SA-4.0": (f"({_NC}).*({_SA}).*4 0", _ND),
    "CC-BY-NC-ND-4.0": (f"({_NC}).*({_ND}).*4 0", _SA),
}
#: A text that says that a licence doesn't hold.
DENIED = "(^| )(not|never|no longer|isn t|aren t|neither) (be |been |currently |yet )?(licensed|licenced|released|distributed|covered|available|offered) (under|by)( |$)"
