"""Public licence notices, with the phrases that must stand in them."""

from typing import NamedTuple


class Template(NamedTuple):
    label: str
    text: str
    #: Each must stand word for word.
    phrases: tuple[str, ...]


#: Phrases that give their label wherever they stand.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the "
    "{} as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version."
)

TEMPLATES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        ("obtaining a copy", "deal in the software"),
    ),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Licensed under the MIT licence.", ("mit licence",)),
    Template(
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("except in compliance with the license",),
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0.", ("apache license",)),
    Template("apache", "Licensed under Apache 2.0.", ("apache 2 0",)),
    Template("gpl", _GNU.format("GNU General Public License"), ("gnu general public license",)),
    Template(
        "gpl", "This work is licensed under the GNU General Public License, version 3.",
        ("gnu general public license",),
    ),
    Template("gpl", "Licensed under the GNU GPL version 3.", ("gnu gpl",)),
    Template("lgpl", _GNU.format("GNU Lesser General Public License"), ("gnu lesser general public license",)),
    Template(
        "lgpl", "Licensed under the GNU Lesser General Public License, version 3.",
        ("gnu lesser general public license",),
    ),
    Template("agpl", _GNU.format("GNU Affero General Public License"), ("gnu affero general public license",)),
    Template(
        "agpl", "Licensed under the GNU Affero General Public License, version 3.",
        ("gnu affero general public license",),
    ),
    Template(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
        ("mozilla public license",),
    ),
    Template("mpl", "Licensed under the Mozilla Public License, version 2.0.", ("mozilla public license",)),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions "
        "in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
        ("source and binary forms", "list of conditions"),
    ),
    Template("bsd", "Released under the BSD 3-Clause License.", ("bsd 3 clause",)),
    Template("bsd", "Released under the BSD 2-Clause License.", ("bsd 2 clause",)),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
        ("with or without fee", "appear in all copies"),
    ),
    Template("isc", "Released under the ISC License.", ("isc license",)),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will "
        "the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, "
        "and to alter it and redistribute it freely, subject to the following restrictions:",
        ("alter it and redistribute it freely",),
    ),
    Template(
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of "
        "the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so",
        ("covered by this license", "derivative works"),
    ),
    Template("boost", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software",),
    ),
    Template(
        "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        ("creative commons attribution 4 0",),
    ),
    Template("cc-by", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template(
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        ("creative commons attribution noncommercial",),
    ),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template(
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        ("creative commons attribution sharealike",),
    ),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    Template("cc0", "Released under CC0 1.0 Universal.", ("cc0 1 0",)),
)
