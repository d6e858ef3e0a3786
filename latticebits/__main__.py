"""python -m latticebits"""

import sys

from latticebits.cli import main

sys.exit(main())
