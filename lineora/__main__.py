import sys

from lineora.cli import main

sys.exit(main())
