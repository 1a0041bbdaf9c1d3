import sys

from veilgrid.cli import main

sys.exit(main())
