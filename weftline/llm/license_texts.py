"""License notices and texts to look for, (license, text): what their authors publish, without list numbers and years."""

from __future__ import annotations

# Published texts.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies."
)
ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
APACHE_WARRANTY = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
    "and limitations under the License."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
)
BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to "
    "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
)
GPL_2_PREAMBLE = (
    "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License "
    "is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General "
    "Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."
)
GPL_3_PREAMBLE = (
    "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and "
    "other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is "
    "intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."
)


def _gnu(kind: str, version: str, program: str = "program") -> tuple[str, str]:
    """The "either version ... or any later version" notice and the notice of one version only."""
    terms = f"{'This ' + program} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License"
    return (
        f"{terms} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"{terms} version {version} as published by the Free Software Foundation.",
    )


#: SPDX name, the words before "General Public License", version, what is licensed.
GNU = (
    ("GPL-2.0", "", "2", "program"),
    ("GPL-3.0", "", "3", "program"),
    ("LGPL-2.1", "Lesser ", "2.1", "library"),
    ("LGPL-3.0", "Lesser ", "3", "library"),
    ("AGPL-3.0", "Affero ", "3", "program"),
)
#: The elements of Creative Commons licenses, short and in words.
CREATIVE_COMMONS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)

TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", MIT_GRANT),
    ("MIT", MIT_WARRANTY),
    ("MIT", f"{MIT_GRANT} {MIT_WARRANTY}"),
    ("ISC", ISC_GRANT),
    ("ISC", ISC_WARRANTY),
    ("ISC", f"{ISC_GRANT} {ISC_WARRANTY}"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", BSD_WARRANTY),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_NAMES} {BSD_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", f"{APACHE_NOTICE} {APACHE_WARRANTY}"),
    ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB),
    ("BSL-1.0", BOOST),
    ("GPL-2.0", GPL_2_PREAMBLE),
    ("GPL-3.0", GPL_3_PREAMBLE),
    *((f"{name}-{'or-later' if later else 'only'}", text) for name, kind, version, what in GNU for later, text in zip((True, False), _gnu(kind, version, what), strict=True)),
    *((name, f"This work is licensed under the GNU {kind}General Public License, version {version}.") for name, kind, version, _ in GNU),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    *((f"CC-{short}-{v}", f"Licensed under CC {short} {v}.") for short, _ in CREATIVE_COMMONS for v in ("4.0", "3.0", "2.0")),
    *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {words} 4.0 International License.") for short, words in CREATIVE_COMMONS),
    *((f"CC-{short}-3.0", f"This work is licensed under a Creative Commons {words} 3.0 Unported License.") for short, words in CREATIVE_COMMONS),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("reserved", "All rights reserved."),
)
#: Words that tell licenses apart, beside all words with a digit: a match holds those of the template, and no other of these.
DECISIVE = frozenset(("lesser", "affero", "later", "nc", "nd", "sa", "noncommercial", "noderivatives", "sharealike"))
