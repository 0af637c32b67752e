"""Where the small test tables are."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
