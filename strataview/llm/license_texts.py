"""License statements and texts as their publishers give them, with what tells them apart.

A template is matched by the share of its words that a block holds. Versions and variants
share nearly all of their words, so each names the words that its block ``must`` hold as
well, and those it may ``never`` hold, which are another license's.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    label: str
    text: str
    must: str = ""
    never: str = ""


#: Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_CC = "This work is licensed under a Creative Commons {name} 4.0 International License. To view a copy of this license, visit creativecommons.org"

#: Statements of one sentence.
STATEMENTS = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    Template("mit", "Released under the MIT License", "mit"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "public 3", "lesser affero"),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "public 2", "lesser affero"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4", "sa nc nd"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4", "nc nd"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4", "sa nd"),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "cc by nd 4", "sa nc"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution International License", "commons attribution", "sharealike noncommercial noderivatives"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike International License", "commons attribution sharealike", "noncommercial noderivatives"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "mozilla 2"),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived"),
    Template("all-rights-reserved", "All rights reserved", "all rights reserved"),
)

#: Notices and license texts of several sentences.
LONG_TEXTS = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "sublicense noninfringement",
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
        "or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    Template("bsd-2-clause", _BSD, "redistributions reproduce", "endorse"),
    Template(
        "bsd-3-clause",
        _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
        "redistributions endorse",
    ),
    Template("gpl-3.0", _GNU.format(name="General Public License", version="3"), "general 3", "lesser affero"),
    Template("gpl-2.0", _GNU.format(name="General Public License", version="2"), "general 2", "lesser affero"),
    Template("lgpl-3.0", _GNU.format(name="Lesser General Public License", version="3"), "lesser 3"),
    Template("lgpl-2.1", _GNU.format(name="Lesser General Public License", version="2.1"), "lesser 2"),
    Template("agpl-3.0", _GNU.format(name="Affero General Public License", version="3"), "affero 3"),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
        "fee granted",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mozilla mpl",
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unencumbered",
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software.",
        "misrepresented",
    ),
    Template(
        "boost-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
        "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        "organization transmit",
    ),
    Template("cc-by-4.0", _CC.format(name="Attribution"), "attribution", "sharealike noncommercial noderivatives"),
    Template("cc-by-sa-4.0", _CC.format(name="Attribution-ShareAlike"), "sharealike", "noncommercial noderivatives"),
    Template("cc-by-nc-4.0", _CC.format(name="Attribution-NonCommercial"), "noncommercial", "sharealike noderivatives"),
    Template("cc-by-nd-4.0", _CC.format(name="Attribution-NoDerivatives"), "noderivatives", "sharealike noncommercial"),
    Template("cc-by-nc-sa-4.0", _CC.format(name="Attribution-NonCommercial-ShareAlike"), "noncommercial sharealike"),
)

TEMPLATES = STATEMENTS + LONG_TEXTS
