from pagewright.cli import main

raise SystemExit(main())
