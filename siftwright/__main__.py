import sys

from siftwright.cli import main

sys.exit(main())
