"""Command line: python run.py --help, or spark-submit run.py ..."""

from headwater.main import main

if __name__ == "__main__":
    main()
