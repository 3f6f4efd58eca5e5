from strandloom.cli import main

main()
