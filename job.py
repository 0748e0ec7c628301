"""For spark-submit: ``spark-submit --py-files lakeload.zip job.py export ...``."""

import sys

from lakeload.__main__ import main

if __name__ == "__main__":
    sys.exit(main())
