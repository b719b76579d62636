"""Phrases that name a licence, and the public notices that grant one."""

#: (label, phrase)
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

_GPL_GRANT = """This program is free software: you can redistribute it and/or modify it under the
terms of the GNU {name} Public License as published by the Free Software Foundation, either
version {version} of the License, or (at your option) any later version."""
_GPL_WARRANTY = """This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {name} Public License for more details."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: 1. Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written
permission."""

#: (label, notice)
TEMPLATES = [
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. """
     + _AS_IS),
    ("bsd-2-clause", _BSD_TERMS),
    ("bsd-3-clause", _BSD_TERMS + " " + _BSD_NAMES),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-2.0-or-later", _GPL_GRANT.format(name="General", version=2)),
    ("gpl-3.0-or-later", _GPL_GRANT.format(name="General", version=3)),
    ("agpl-3.0-or-later", _GPL_GRANT.format(name="Affero General", version=3)),
    ("lgpl-2.1-or-later", _GPL_GRANT.format(name="Lesser General", version="2.1")),
    ("gpl-warranty", _GPL_WARRANTY.format(name="General")),
    ("agpl-warranty", _GPL_WARRANTY.format(name="Affero General")),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v.
2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is
free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means."""),
    ("cc0-1.0", """To the extent possible under law, the author has waived all copyright and related or
neighboring rights to this work."""),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", """licensed under a Creative Commons Attribution-ShareAlike 4.0 International
License"""),
    ("cc-by-nc-4.0", """licensed under a Creative Commons Attribution-NonCommercial 4.0 International
License"""),
]
