"""Licence statements as they are found, none of which is a template word for word, and what only sounds like one."""

import numpy as np

from codequarry.llm.licenses import OTHERS, TEMPLATES, fit_licenses, scan_licenses

#: statement -> licences, unknown (1 where a licence of no family is declared)
REAL = [
    ("SPDX-License-Identifier: EUPL-1.2", "", 1), ("Business Source License 1.1", "", 1), ("All rights reserved by the hotel for any change of the booking", "", 0), ("Apache License Version 2.0, January 2004", "Apache-2.0", 0), ("The MIT License (MIT) Copyright (c) 2015 the authors", "MIT", 0),
    ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GPL", 0), ("This file is licensed under the GPLv3 or any later version", "GPL", 0), ("Dual licensed under the MIT license and the Apache License", "Apache-2.0,MIT", 0), ("We granted permission to redistribute the public library", "", 0), ("Copyright (c) 2019 Example Corp. All rights reserved.", "proprietary", 0),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge", "MIT", 0),
    ("Licensed to the Apache Software Foundation under one or more contributor license agreements. The ASF licenses this file to you under the Apache License, Version 2.0", "Apache-2.0", 0),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "GPL", 0),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "LGPL", 0),
    ("This program is free software: you can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3", "AGPL", 0),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice", "BSD", 0),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD", 0), ("SPDX-License-Identifier: BSD-2-Clause-Patent", "BSD", 0), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file", "MPL-2.0", 0), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "Apache-2.0,MIT", 0),
    ("This article is distributed under the terms of the Creative Commons Attribution 4.0 International License, which permits unrestricted use", "CC-BY", 0), ("Text is available under the Creative Commons Attribution-ShareAlike License 4.0", "CC-BY-SA", 0), ("Photos are licensed under CC BY-NC 4.0 unless noted", "CC-BY-NC", 0), ("To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work", "CC0", 0),
    ("All data files are offered under CC0 by their authors", "CC0", 0), ("Licensed under the Apache 2.0 licence", "Apache-2.0", 0), ("released under the terms of the GNU GPL v2", "GPL", 0), ("LGPL-2.1 licensed library", "LGPL", 0), ("This code is distributed under the Eclipse Public License v2.0", "", 1), ("Licensed under the Academic Free License version 3.0", "", 1),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "", 1), ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish", "", 1), ("the author renewed the driving licence in the city", "", 0), ("general public access to the park is free", "", 0), ("a copy of the letter was distributed to any person in the room", "", 0), ("the museum holds the copyright of the photographs", "", 0),
    ("she was licensed to teach under the old rules", "", 0), ("Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential. Written by J. Doe", "proprietary", 0), ("No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher", "proprietary", 0), ("This project is licensed under the MIT License - see the LICENSE file for details", "MIT", 0),
]


def test_statements_as_they_are_found(spark):
    rng = np.random.default_rng(15)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    plain = [(1000 + k, " ".join(word() for _ in range(60))) for k in range(300)]
    model = fit_licenses(spark.createDataFrame(plain, "doc_id long, text string"))
    assert len(REAL) == 40 and not {t for t, _, _ in REAL} & {*OTHERS, *sum(TEMPLATES.values(), [])}
    around = " ".join(word() for _ in range(40))
    rows = [(k, t) for k, (t, _, _) in enumerate(REAL)] + [(100 + k, f"{around} {around}\n\n{t}\n\n{around}") for k, (t, _, _) in enumerate(REAL)]
    got = {r["doc_id"]: (r["licenses"], r["n_unknown"]) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    wrong = [(t, want, u, got[k]) for k, (t, want, u) in enumerate(REAL) if got[k] != (want, u)]
    assert not wrong and all(got[100 + k] == got[k] for k in range(40))
