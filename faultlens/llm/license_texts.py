"""Wordings of licences: short notices, standard headers, identifiers, and the texts of the short licences."""

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = """provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_REST = """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_MPL_REST = "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def _gnu(name: str, version: str, thing: str = "program") -> tuple[str, ...]:
    """Standard header of a GNU licence: its first sentence for "or later" and for "only", and with the disclaimer."""
    start = f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, "
    later = start + f"either version {version} of the License, or (at your option) any later version."
    rest = (f" This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
            f"FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {thing}.")
    return (f"This work is licensed under the GNU {name}, version {version}.", f"This {thing} is licensed under the GNU {name}, version {version}.", later, later + rest,
            start + f"version {version} of the License.")


def _tags(*ids: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {i}" for i in ids)


def _gnu_tags(name: str) -> tuple[str, ...]:
    return _tags(name, f"{name}-only", f"{name}-or-later")


def _cc(kind: str, path: str, name: str) -> tuple[str, ...]:
    return (f"Licensed under CC {kind} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License.",
            f"creativecommons.org/licenses/{path}/4.0", *_tags(f"CC-{kind.replace(' ', '-')}-4.0"))


# Wordings by licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", _APACHE, f"{_APACHE} {_APACHE_REST}",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", *_tags("Apache-2.0")),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT_GRANT, f"{_MIT_GRANT} {_MIT_NOTICE}", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}",
            *_tags("MIT")),
    "GPL-3.0": (*_gnu("General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu_tags("GPL-3.0")),
    "GPL-2.0": (*_gnu("General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", *_gnu_tags("GPL-2.0")),
    "LGPL-2.1": (*_gnu("Lesser General Public License", "2.1", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_gnu_tags("LGPL-2.1")),
    "LGPL-3.0": (*_gnu("Lesser General Public License", "3", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu_tags("LGPL-3.0")),
    "AGPL-3.0": (*_gnu("Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", *_gnu_tags("AGPL-3.0")),
    "BSD-3-Clause": (_BSD_GRANT, f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD}", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}", *_tags("BSD-3-Clause")),
    "BSD-2-Clause": (f"{_BSD_GRANT} {_BSD_TWO}", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_WARRANTY}", *_tags("BSD-2-Clause")),
    "MPL-2.0": (_MPL, f"{_MPL} {_MPL_REST}", *_tags("MPL-2.0")),
    "CC-BY-4.0": _cc("BY", "by", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "by-sa", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _cc("BY-NC", "by-nc", "Attribution-NonCommercial"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.", *_tags("CC0-1.0")),
    "Unlicense": (_UNLICENSE, f"{_UNLICENSE} {_UNLICENSE_REST}", *_tags("Unlicense")),
    "ISC": (f"{_ISC_GRANT}.", f"{_ISC_GRANT}, {_ISC_REST}", *_tags("ISC")),
    "All-Rights-Reserved": ("Copyright. All rights reserved.",),
}
