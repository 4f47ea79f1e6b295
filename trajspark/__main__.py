import sys

from trajspark.cli import main

sys.exit(main())
