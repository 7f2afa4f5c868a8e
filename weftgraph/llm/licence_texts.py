"""Texts by which licences are known. Notices and licence bodies are quoted from the public licences."""

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""

_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""

_APACHE_BODY = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,
REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and
distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity
authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and
all other entities that control, are controlled by, or are under common control with that entity. "You" (or "Your") shall
mean an individual or Legal Entity exercising permissions granted by this License. "Source" form shall mean the preferred form
for making modifications, including but not limited to software source code, documentation source, and configuration files.
"Object" form shall mean any form resulting from mechanical transformation or translation of a Source form. "Work" shall mean
the work of authorship, whether in Source or Object form, made available under the License, as indicated by a copyright notice
that is included in or attached to the work. "Derivative Works" shall mean any work, whether in Source or Object form, that is
based on (or derived from) the Work. "Contribution" shall mean any work of authorship, including the original version of the
Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted to Licensor
for inclusion in the Work by the copyright owner. "Contributor" shall mean Licensor and any individual or Legal Entity on
behalf of whom a Contribution has been received by Licensor and subsequently incorporated within the Work. 2. Grant of
Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of,
publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form. 3.
Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a
perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to
sell, sell, import, and otherwise transfer the Work. 4. Redistribution. You may reproduce and distribute copies of the Work or
Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet
the following conditions: You must give any other recipients of the Work or Derivative Works a copy of this License; and You
must cause any modified files to carry prominent notices stating that You changed the files."""


def _gnu(program: str, name: str, version: str) -> str:
    """The header that the licences of this family ask for."""
    return (
        f"{program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version. {program} is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        f"PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If "
        "not, see https://www.gnu.org/licenses/."
    )


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {n}" for n in names)


TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (_gnu("This program", "GNU Affero General Public License", "3"), "GNU Affero General Public License, version 3", *_spdx("AGPL-3.0-only", "AGPL-3.0-or-later")),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", _APACHE_NOTICE, _APACHE_BODY, *_spdx("Apache-2.0")),
    "BSD-2-Clause": (f"{_BSD_TERMS} {_BSD_DISCLAIMER}", "BSD 2-Clause License", *_spdx("BSD-2-Clause")),
    "BSD-3-Clause": (f"{_BSD_TERMS} {_BSD_THIRD} {_BSD_DISCLAIMER}", "BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", *_spdx("BSD-3-Clause")),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CC BY 4.0", *_spdx("CC-BY-4.0")),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "licensed under CC BY-NC 4.0", *_spdx("CC-BY-NC-4.0")),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "licensed under CC BY-SA 4.0", *_spdx("CC-BY-SA-4.0")),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide under CC0 1.0 Universal", "CC0 1.0 Universal public domain dedication", *_spdx("CC0-1.0")),
    "GPL-2.0": (_gnu("This program", "GNU General Public License", "2"), "GNU General Public License, version 2", *_spdx("GPL-2.0-only", "GPL-2.0-or-later")),
    "GPL-3.0": (_gnu("This program", "GNU General Public License", "3"), "licensed under the GNU General Public License, version 3", *_spdx("GPL-3.0-only", "GPL-3.0-or-later")),
    "ISC": (_ISC_BODY, "ISC License", *_spdx("ISC")),
    "LGPL-3.0": (_gnu("This library", "GNU Lesser General Public License", "3"), "GNU Lesser General Public License, version 3", *_spdx("LGPL-3.0-only", "LGPL-3.0-or-later")),
    "MIT": (_MIT_BODY, "MIT License", "Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", *_spdx("MIT")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0", *_spdx("MPL-2.0")),
    "Proprietary": ("Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", *_spdx("Unlicense")),
}
