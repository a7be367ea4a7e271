"""Notices of licence families, from which the licence classifier is trained and which confirm its findings.

All of them are fixed values: public notices and the opening sentences of public licence texts.
"""

from __future__ import annotations

NOTICES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has dedicated all copyright to this work to the public domain under CC0 1.0.",
        "This work is in the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Ltd. All rights reserved.",
        "This document is confidential and proprietary; no part of it may be reproduced without prior written permission.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}

#: Ordinary sentences with words of licences, so that such words alone prove nothing.
ORDINARY: list[str] = [
    "The driver showed his license to the officer and was free to go.",
    "The version of the story that she told was different from the one in the newspaper.",
    "General public opinion changed after the war.",
    "They were granted permission to enter the building without any restriction.",
    "He released the album in the spring and the work was well received.",
    "The restaurant lost its license under the new law.",
    "She reserved a table for four and all of them came.",
    "The common lands of the village were open to the public.",
    "The copyright of the song was sold to a company in London.",
    "Software is written by people for other people.",
    "The apache helicopter flew over the river.",
    "Students at the institute worked on the project under the terms of the agreement.",
]
