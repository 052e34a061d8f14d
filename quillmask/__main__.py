import sys

from quillmask.cli import main

sys.exit(main())
