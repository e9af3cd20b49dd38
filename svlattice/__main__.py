from svlattice.cli import main

raise SystemExit(main())
