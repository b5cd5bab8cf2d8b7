"""Known licence sentences and the ordered rules over their identifiers.

The wording is fixed: it is that of the published licences and of common references
to them.  A rule names a licence and the identifiers that make it, in order.
"""

# --- fixed values: (identifier, sentence) -----------------------------------------------
_SENTENCES = (
    ("apache2-ref", "Licensed under the Apache License, Version 2.0."),
    ("apache2-ref", "This project is licensed under the Apache License, Version 2.0."),
    ("apache2-ref", "Licensed under the Apache License 2.0."),
    ("apache2-head", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache2-head", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache2-use", "you may not use this file except in compliance with the License."),
    ("apache2-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-basis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit-ref", "Released under the MIT License."),
    ("mit-ref", "Licensed under the MIT License."),
    ("mit-ref", "This project is licensed under the MIT License."),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "MIT License"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("no-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-use", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl3-ref", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3-ref", "Licensed under the GNU General Public License, version 3."),
    ("gpl2-ref", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl2-ref", "Licensed under the GNU General Public License, version 2."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl2-terms", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc4-ref", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc4-ref", "This work is licensed under CC BY-NC 4.0."),
    ("cc-by4-ref", "Licensed under CC BY 4.0."),
    ("cc-by4-ref", "This work is licensed under CC BY 4.0."),
    ("cc-by-sa4-ref", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa4-ref", "This work is licensed under CC BY-SA 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("gpl-more", "See the GNU General Public License for more details."),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl-else", "If not, see <https://www.gnu.org/licenses/>."),
    ("gpl-else", "If not, see <http://www.gnu.org/licenses/>."),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl-more", "See the GNU Lesser General Public License for more details."),
    ("lgpl-copy", "You should have received a copy of the GNU Lesser General Public License along with this program."),
    ("lgpl-copy", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-more", "See the GNU Affero General Public License for more details."),
    ("agpl-copy", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl2-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl1-terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-liable", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("zlib-product", "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution."),
    ("bsl1-ref", "Distributed under the Boost Software License, Version 1.0."),
    ("bsl1-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("bsl1-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("isc-as-is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("isc-liable", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("bsd-as-is", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("cc0-title", "CC0 1.0 Universal"),
    ("cc0-waiver", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("cc0-warranty", "This software is distributed without any warranty."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

# --- fixed values: (licence, its name in a reference) -------------------------------------
NAMES = (
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("MIT", "MIT License"), ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("0BSD", "BSD Zero Clause License"),
    ("GPL-2.0-only", "GNU General Public License, version 2"), ("GPL-3.0-only", "GNU General Public License, version 3"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, version 2.1"), ("LGPL-3.0-only", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0-only", "GNU Affero General Public License, version 3"), ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("EPL-1.0", "Eclipse Public License 1.0"), ("EPL-2.0", "Eclipse Public License 2.0"), ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Zlib", "zlib License"), ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
)
REFERENCES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.")

# --- fixed values: licence identifiers of the SPDX list -----------------------------------
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC-BY-NC-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
)


def _references() -> list[tuple[str, str]]:
    """Sentences that name a licence and nothing else; those listed above keep their identifier."""
    listed = {text for _, text in _SENTENCES}
    out = [(f"ref:{licence}", form.format(name)) for licence, name in NAMES for form in REFERENCES]
    out += [(f"spdx:{licence}", f"SPDX-License-Identifier: {licence}") for licence in SPDX]
    return [(identifier, text) for identifier, text in out if text not in listed]


SENTENCES = (*_SENTENCES, *_references())

# --- fixed values: (licence, identifiers in order); at a place the first that fits holds ---
_RULES = (
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-more", "gpl-copy", "gpl-else")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-more", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-more")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-more", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-more")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-more", "lgpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-more")),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-more", "lgpl-copy", "gpl-else")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-more")),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-more", "agpl-copy", "gpl-else")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-more")),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-2.0", ("mpl2-terms", "mpl2-copy")),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-product", "zlib-altered", "zlib-notice")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("BSL-1.0", ("bsl1-title", "bsl1-grant")),
    ("BSL-1.0", ("bsl1-grant",)),
    ("BSL-1.0", ("bsl1-ref",)),
    ("0BSD", ("0bsd-grant", "isc-as-is", "isc-liable")),
    ("0BSD", ("0bsd-grant",)),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liable")),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("CC0-1.0", ("cc0-waiver", "cc0-warranty")),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC0-1.0", ("cc0-title",)),
    ("Unlicense", ("unlicense", "unlicense-anyone")),
    ("Apache-2.0", ("apache2-head", "apache2-use", "apache2-copy", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-head", "apache2-copy", "apache2-basis", "apache2-see")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("Apache-2.0", ("apache2-head",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("MIT", ("mit-ref",)),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-ref",)),
    ("CC-BY-4.0", ("cc-by4-ref",)),
    ("Unlicense", ("unlicense",)),
    ("MIT", ("mit-title",)),
)
RULES = (
    *_RULES,
    *((licence, (f"ref:{licence}",)) for licence in dict.fromkeys(licence for licence, _ in NAMES)),
    *((licence, (f"spdx:{licence}",)) for licence in SPDX),
)
