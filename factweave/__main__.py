import sys

from factweave.surface import main

sys.exit(main(sys.argv[1:]))
