"""``python -m speechmill``."""

import sys

from speechmill.cli import main

sys.exit(main())
